import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire import vocab
from tidewire.functions import gates as G
from tidewire.operators import options as O

POSITION = "topic string, candidate string, position_type string, stance string, summary_pt string, summary_en string, key_actions array<string>, sources array<struct<description_pt: string, description_en: string, url: string, date: string>>, topic_label_pt string, topic_label_en string"


def value(spark, column, **cells):
    return spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in cells.items())).select(column.alias("x")).first().x


def print_of(text):
    return re.sub(r"[^\w\s]", "", " ".join(text.lower().split()))


def failed(spark, texts):
    """Which texts fail a check, by the library's own checks, which have tests of their own."""
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, pt string, en string")
    return {texts[r.i] for r in df.select("i", (F.size(G.option_failures("pt", "en")) > 0).alias("bad")).collect() if r.bad}


def template(topic, candidate, stance, offset, label_pt, label_en):
    k = int(hashlib.sha256(f"{topic}:{candidate}:{stance}:{offset}".encode()).hexdigest()[:8], 16) % 4
    named = lambda label: (label or "").lower() or topic.replace("_", " ")
    return (f"{vocab.INTROS[k]} o governo {vocab.STANCE_PT[stance]} em {named(label_pt)}, {vocab.ENDING_PT}", f"{vocab.INTROS_EN[k]} {vocab.STANCE_EN[stance]} on {named(label_en)}, {vocab.ENDING_EN}")


def brute(spark, positions, generated):
    every = [(g[3], g[4]) for g in generated if g[3] and g[4]]
    bad = failed(spark, every)
    out = {}
    for topic in sorted({p[0] for p in positions}):
        known = sorted((p for p in positions if p[0] == topic and p[2] in vocab.KNOWN_TYPES and p[3] in vocab.STANCES), key=lambda p: p[1])
        taken = []

        def take(p, weight, texts):
            for pt, en in texts:
                if (pt, en) not in bad and all(print_of(pt) != print_of(o[2]) and print_of(en) != print_of(o[3]) for o in taken):
                    return taken.append((p[1], weight, pt, en))

        for _, _, mapped, pt, en, stance, weight in sorted((g for g in generated if g[0] == topic), key=lambda g: g[1]):
            free = [p for p in known if p[1] not in {o[0] for o in taken}]
            p = known[mapped - 1] if mapped is not None and 1 <= mapped <= len(known) else free[0] if free else None
            if len(taken) == 6 or p is None or p not in free or not (pt or "").strip() or not (en or "").strip():
                continue
            stance = stance if stance in vocab.STANCES else p[3]
            weight = weight if weight in vocab.STANCES.values() else vocab.STANCES[stance]
            take(p, weight, [(pt, en), *(template(topic, p[1], stance, k, p[8], p[9]) for k in range(16))])
        for p in known:
            if len(taken) < 6 and p[1] not in {o[0] for o in taken}:
                take(p, vocab.STANCES[p[3]], [template(topic, p[1], p[3], k, p[8], p[9]) for k in range(16, 40)])
        if len(taken) >= 3:
            for k, o in enumerate(taken):
                p = next(p for p in known if p[1] == o[0])
                out[topic, vocab.OPTION_IDS[k]] = (*o, "high" if p[2] == "confirmed" else "medium", *((p[7][0][2], p[7][0][0]) if p[7] else (None, "")))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assembly_matches_one_option_after_the_other(spark, seed):
    r = random.Random(seed)
    stances = [*vocab.STANCES, "unknown"]
    positions = [(f"t_{t}", c, r.choice(["confirmed", "inferred", "unknown"]) if r.random() < 0.4 else "confirmed", r.choice(stances), None, None, None, [("fonte", "source", f"u{t}{c}", None), ("b", "b", "b", None)] if r.random() < 0.5 else None, f"Tema {t}", f"Topic {t}") for t in range(12) for c in vocab.SLUGS[: r.randint(1, 9)]]
    good = [("Defendo que o governo amplie o orçamento das escolas técnicas em todas as cidades do país até o próximo ano letivo.", f"I believe the government should widen school budgets in town {k} soon.") for k in range(3)]
    texts = [*good, ("Curto demais.", "Too short."), ("Lula defende que o governo amplie o orçamento das escolas técnicas em todas as cidades do país agora.", "x y"), (None, "no text"), ("  ", "blank")]
    generated = [(f"t_{t}", k, r.choice([None, 0, 1, 2, 3, 9, 40]), *r.choice(texts), r.choice([*stances, None]), r.choice([None, 3, -2, 0, 1, 7])) for t in range(12) for k in range(r.randint(0, 9))]
    p, g = spark.createDataFrame(positions, POSITION), spark.createDataFrame(generated, O.GENERATED)
    got = {(x.topic, x.option_id): (x.candidate, x.weight, x.text_pt, x.text_en, x.confidence, x.source_url, x.source_pt) for x in O.assemble(p, g).collect()}
    assert got == brute(spark, positions, generated) and got
    got = {(x.topic, x.option_id): (x.candidate, x.weight, x.text_pt, x.text_en, x.confidence, x.source_url, x.source_pt) for x in O.assemble(p).collect()}
    assert got == brute(spark, positions, [])


def test_registered_query_matches_one_option_after_the_other(spark):
    from tidewire.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    rows = Q._sourced_positions(spark, sf).collect()
    positions = [(r.topic, r.candidate, r.position_type, r.stance, None, None, None, [tuple(x) for x in r.sources] if r.sources else None, None, None) for r in rows]
    generated = [tuple(r[c] for c in ("topic", "place", "mapped_position", "text_pt", "text_en", "stance", "weight")) for r in Q._generated(spark, sf).collect()]
    got = {(x.topic, x.option_id): (x.candidate, x.weight, x.text_pt, x.text_en, x.confidence, x.source_url, x.source_pt) for x in Q.m06_generated_options(spark, sf).collect()}
    assert got == brute(spark, positions, generated) and len(got) > 20


def test_hints_and_texts(spark):
    assert value(spark, O.summary_hint("s"), s="Prioriza expansão do ensino técnico. E mais.") == "Prioriza expansão do ensino técnico"
    assert value(spark, O.summary_hint("s"), s="Muito curto. Segunda frase com palavras suficientes aqui") is None
    assert value(spark, O.summary_hint("s"), s="Como membro do psdb, apoia a reforma tributária já") is None
    assert value(spark, O.summary_hint("s"), s="O partido dele tem postura conservadora sobre esse tema") is None
    assert value(spark, O.summary_hint("s"), s="Segundo pesquisa, Lula quer ampliar as escolas de tempo integral,") == "Segundo , quer ampliar as escolas de tempo integral"
    pt, en = O.position_texts("i", "t", "lp", "le", "s", "hp", "he", "a")
    cells = {"t": "educacao", "lp": "Educação", "le": "", "s": "favor", "hp": "Prioriza expansão do ensino técnico", "he": None, "a": "Ampliar escolas de tempo integral"}
    both = spark.range(1).select(F.lit(0).alias("i"), *(F.lit(v).cast("string").alias(k) for k, v in cells.items())).select(pt.alias("pt"), en.alias("en")).first()
    assert both.pt == "Defendo que o governo avance com reformas graduais e metas públicas verificáveis em educação, com metas transparentes e revisão periódica. Também considero importante prioriza expansão do ensino técnico. Além disso, proponho ampliar escolas de tempo integral."
    assert both.en == "I believe the government should advance gradual reforms with transparent and measurable goals on educacao, with transparent goals and periodic review."


def test_party_names_and_broken_sentences(spark):
    party = lambda t: value(spark, G.party_reference("t"), t=t)
    assert [party(t) for t in ("apoia o PT", "otimo apto", "um novo caminho", "filiado ao novo", "integrante do movimento", "como membro", "democracia cristã já", None)] == [True, False, False, True, True, True, True, False]
    start = "Defendo que o governo amplie o orçamento das escolas técnicas em todas as cidades do país até 2030"
    fails = lambda t, e="ok": value(spark, F.array_join(G.option_failures("t", "e"), ","), t=t, e=e)
    assert fails(start) == "" and fails(start, "here is the json requested: x") == "broken_continuation" and fails(start + ", , e mais") == "broken_continuation"
    assert fails(start + " o que é um ato") == "broken_continuation" and "boilerplate" in fails("O governo deveria adotar uma política pública clara e estável em que " + start)
