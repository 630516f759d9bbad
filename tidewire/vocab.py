"""Default vocabularies and thresholds; every operator takes its own as a parameter."""

from __future__ import annotations

import unicodedata

# ---- Fixed values: keyword sets of the relevance gates; they are sets, so their order, the alphabet, means nothing ----
HIGH_SIGNAL = ("2026", "campanha eleitoral", "candidato", "candidatos", "candidatura", "debate presidencial", "eleicao", "eleicoes", "eleitor", "eleitoral", "eleitores", "intencao de voto", "pesquisa de voto", "pesquisa eleitoral", "plano de governo", "pre candidato", "pre-candidato", "presidencia", "presidencial", "primeiro turno", "reeleicao", "reeleito", "segundo turno", "terceira via", "tse", "turno", "urna", "urnas", "votacao", "voto", "votos")
CANDIDATE_WORDS = ("aldo rebelo", "bolsonaro", "caiado", "eduardo leite", "flavio bolsonaro", "lula", "ratinho jr", "renan santos", "tarcisio", "zema")
CONTEXT = ("brasil", "brasileira", "brasileiro", "brasilia", "camara dos deputados", "governo federal", "palacio do planalto", "planalto", "senado federal", "stf", "supremo", "tse")
OFF_TOPIC = ("bem estar", "campeonato", "celebridade", "culinaria", "dieta", "entretenimento", "esporte", "filme", "futebol", "horoscopo", "musica", "novela", "receita", "saude", "serie")
INTERNATIONAL = ("biden", "china", "consumer sentiment", "dow jones", "estados unidos", "eua", "europa", "fed ", "federal reserve", "nasdaq", "russia", "s&p 500", "trump", "ucrania", "wall street")
POLITICAL_TOPICS = ("corrupcao", "impostos", "previdencia", "privatizacao")
PAYWALL = ("assine a folha", "assine ou faça login", "assine uol", "benefício do assinante", "faça seu login", "já é assinante?", "recurso exclusivo para assinantes", "só para assinantes")
BLOCKED_PAGE = ("403 forbidden", "404 not found", "access denied", "are you a robot", "captcha", "checking your browser", "cloudflare", "ddos protection", "enable cookies", "just a moment", "one more step", "please enable javascript", "please wait while we check", "security check", "verify you are human", "you have been blocked")
RELEVANT, SIMILAR, JACCARD, WINDOW_HOURS = 0.30, 0.75, 0.80, 48

# ---- Fixed values: candidates and their names ----
SLUGS = ("aldo-rebelo", "caiado", "eduardo-leite", "flavio-bolsonaro", "lula", "ratinho-jr", "renan-santos", "tarcisio", "zema")
ALIASES = {"aldo rebelo": "aldo-rebelo", "caiado": "caiado", "carlos massa ratinho jr": "ratinho-jr", "carlos massa ratinho junior": "ratinho-jr", "eduardo leite": "eduardo-leite", "flavio bolsonaro": "flavio-bolsonaro", "luiz inacio lula da silva": "lula", "lula": "lula", "ratinho jr": "ratinho-jr", "renan santos": "renan-santos", "romeu zema": "zema", "ronaldo caiado": "caiado", "tarcisio": "tarcisio", "tarcisio de freitas": "tarcisio", "zema": "zema"}
#: In the order in which a contained alias is looked for.
POLL_ALIASES = (("lula", "lula"), ("luiz inacio lula da silva", "lula"), ("flavio bolsonaro", "flavio-bolsonaro"), ("flávio bolsonaro", "flavio-bolsonaro"), ("tarcisio", "tarcisio"), ("tarcísio", "tarcisio"), ("caiado", "caiado"), ("zema", "zema"), ("ratinho jr", "ratinho-jr"), ("ratinho júnior", "ratinho-jr"), ("ratinho junior", "ratinho-jr"), ("eduardo leite", "eduardo-leite"), ("aldo rebelo", "aldo-rebelo"), ("renan santos", "renan-santos"))
INSTITUTES = ("AtlasIntel", "Datafolha", "Futura Inteligencia", "Ideia", "Ipsos", "MDA", "Parana Pesquisas", "PoderData", "Quaest", "Real Time Big Data")
#: In the order in which a contained alias is looked for.
INSTITUTE_ALIASES = (("data folha", "Datafolha"), ("datafolha", "Datafolha"), ("genial/quaest", "Quaest"), ("genial quaest", "Quaest"), ("atlas intel", "AtlasIntel"), ("paraná pesquisas", "Parana Pesquisas"), ("parana pesquisas", "Parana Pesquisas"), ("poder data", "PoderData"), ("real time bigdata", "Real Time Big Data"), ("real time", "Real Time Big Data"), ("futura inteligência", "Futura Inteligencia"), ("futura inteligencia", "Futura Inteligencia"), ("apex/futura", "Futura Inteligencia"), ("futura/apex", "Futura Inteligencia"), ("futura/inteligência", "Futura Inteligencia"), ("futura/inteligencia", "Futura Inteligencia"), ("ipsos-ipec", "Ipsos"), ("ipec", "Ipsos"), ("cnt/mda", "MDA"), ("mda pesquisa", "MDA"), ("meio/ideia", "Ideia"), ("ideia big data", "Ideia"))
#: In the order of precedence when an article names several.
INSTITUTE_PATTERNS = (("Datafolha", r"\bdatafolha\b"), ("Quaest", r"\bquaest\b"), ("AtlasIntel", r"\batlas\s*intel\b"), ("Parana Pesquisas", r"\bparana\s*pesquisas?\b"), ("PoderData", r"\bpoder\s*data\b"), ("Real Time Big Data", r"\breal\s*time\s*(?:big\s*)?data\b"), ("Futura Inteligencia", r"\bfutura\s*intelig[eê]ncia\b"), ("Ipsos", r"\bipsos\b"), ("MDA", r"\b(?:cnt/?mda|mda)\b"), ("Ideia", r"\b(?:meio/?ideia|ideia)\b"))

# ---- Fixed values: patterns of poll facts in text, which decide what is read ----
YEAR_FIRST = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
DAY_FIRST = r"\b(\d{1,2})[-/](\d{1,2})[-/](20\d{2})\b"
#: In the order in which they are tried.
SAMPLE_PATTERNS = (r"(?i)amostra[^0-9]{0,20}([\d., ]{3,})", r"(?i)(\d[\d., ]{2,})\s*(?:entrevistas|respondentes|eleitores)")
MARGIN_PATTERN = r"(?i)(?:margem de erro|erro)[^0-9]{0,20}(\d{1,2}(?:[,.]\d+)?)"
PERCENT_PATTERN = r"(\d{1,2}(?:[,.]\d+)?)"
CONFIDENCE_PATTERN = r"(?i)(?:confianca|confidence)[^0-9]{0,12}(\d{2,3})\s*%"
REGISTRATION_PATTERN = r"([A-Z]{2,4}-\d{1,5}/\d{4})"

# ---- Fixed values: openings of position texts ----
INTROS = ("Defendo que", "Acredito que", "Entendo que", "Na minha visão,")

# ---- Fixed values: source categories, statuses, sentiment, stances ----
CATEGORIES = ("mainstream", "politics", "magazine", "party", "institutional", "international", "social")
CATEGORY_ORDER = {"politics": 1, "mainstream": 2, "magazine": 3, "institutional": 4, "international": 5, "party": 6, "social": 7}
CATEGORY_WEIGHT = {"politics": 0.95, "mainstream": 0.8, "magazine": 0.7, "international": 0.65, "institutional": 0.6, "party": 0.55, "social": 0.5}
#: What a source of no known category weighs.
OTHER_CATEGORY_WEIGHT = 0.6
TOPICS = ("economia", "seguranca", "saude", "educacao", "meio_ambiente", "corrupcao", "armas", "privatizacao", "previdencia", "politica_externa", "lgbtq", "aborto", "indigenas", "impostos", "midia", "eleicoes")
STATUSES = ("raw", "validated", "curated", "irrelevant")
LABELS = {"positivo": 1.0, "neutro": 0.0, "negativo": -1.0}
STANCES = {"strongly_favor": 3, "favor": 2, "neutral": 0, "against": -2, "strongly_against": -3}
KNOWN_TYPES = ("confirmed", "inferred")
OPTION_IDS = ("opt_a", "opt_b", "opt_c", "opt_d", "opt_e", "opt_f")
EVENT_TERMS = ("denuncia", "denúncia", "inquerito", "inquérito", "investigacao", "investigação", "percentual", "pesquisa", "sondagem")
NAME_TERMS = ("aldo rebelo", "bolsonaro", "caiado", "eduardo leite", "lula", "ratinho", "renan santos", "tarcisio", "tarcísio", "zema")
OPENINGS = ("a prioridade", "acredito que", "considero que", "defendo que", "e fundamental", "entendo que", "eu acredito que", "eu defendo", "na minha visao", "na minha visão", "não apoio que", "o estado", "o governo", "prefiro que", "quero que", "sou contra", "sou favoravel", "sou favorável", "é fundamental")
PARTY_TERMS = (
    "pt", "partido dos trabalhadores", "pl", "partido liberal", "psol", "partido socialismo e liberdade", "pcb", "partido comunista brasileiro", "pcdob", "pc do b", "partido comunista do brasil",
    "pdt", "partido democrático trabalhista", "partido democratico trabalhista", "psb", "partido socialista brasileiro", "psdb", "partido da social democracia brasileira",
    "mdb", "movimento democrático brasileiro", "movimento democratico brasileiro", "pmdb", "psd", "partido social democrático", "partido social democratico", "pp", "progressistas", "partido progressista",
    "republicanos", "união brasil", "uniao brasil", "novo", "podemos", "solidariedade", "avante", "cidadania", "pv", "partido verde", "rede", "rede sustentabilidade", "agir", "dc", "democracia cristã", "democracia crista",
    "dem", "democratas", "patriota", "prd", "prtb", "pmb", "partido da mulher brasileira", "mobiliza", "pmn", "psc", "pros", "ptb", "pco", "partido da causa operária", "partido da causa operaria",
    "up", "unidade popular", "pstu", "mbl", "movimento brasil livre",
)
#: Of these, everyday words, which count only beside a party marker.
AMBIGUOUS_PARTY_TERMS = ("novo", "podemos", "solidariedade", "avante", "cidadania", "rede", "agir", "patriota", "mobiliza")
PARTY_MARKER = r"\b(?:partido|legenda|sigla|filiad[oa]|membro|integrante|aliado|alian[aç]a|movimento)\b"
AFFILIATIONS = (
    r"\bpartido\b.*\b(partido|psdb|pt|pl|psol|mbl|republicanos|un[iã]o\s*brasil|novo|mdb|pdt|psb|pp|psd|pv|dc|dem)\b",
    r"\bcomo\s+membro\b",
    r"\bfiliad[oa]\b.*\b(partido|movimento)\b",
    r"\bintegrante\b.*\b(partido|movimento)\b",
    r"\bo\s+partido\b",
)
BOILERPLATE_PT = ("o governo deveria adotar uma política pública clara e estável em que",)
BOILERPLATE_EN = ("the government should adopt a clear and stable public policy in which",)
#: Sentences that were glued together wrongly, in either language.
BROKEN = (
    r"\b(isso\s+inclui\s+[a-zéêãõ]{1,4}\s)",
    r"\b(tamb[eé]m\s+[eé]\s+essencial\s+[a-zéêãõ]{1,4}\s)",
    r"\b(\b[a-zéêãõ]{1,3}\b\s){3,}",
    r",\s*,",
    r"apoiou\s+a\s+reforma|defendeu\s+a\s+reforma|apoia\s+a\s+reforma|votou\s+a\s+favor\s+do\s+processo",
    r"dados\s+da\s+wikipedia",
    r"\.\s+na\s+pauta\s+de\b",
    r"\bpolicy\s+for\b.*\bshould\s+(?:supports|advocates|prefers|defends)\b",
    r"\bi\s+believe\s+the\s+policy\s+for\b",
    r"^\s*here\s+is\s+the\s+json\s+requested\b",
)

# ---- Fixed values: parts of position texts ----
INTROS_EN = ("I believe the government should", "I argue the government should", "In my view, the government should", "I support the government choosing to")
STANCE_PT = {
    "strongly_favor": "priorize mudanças amplas com expansão de direitos e de políticas públicas",
    "favor": "avance com reformas graduais e metas públicas verificáveis",
    "neutral": "busque equilíbrio pragmático antes de ampliar mudanças estruturais",
    "against": "mantenha estabilidade institucional e evite mudanças bruscas sem consenso",
    "strongly_against": "preserve o modelo atual e rejeite reformas de ruptura sem justificativa sólida",
}
STANCE_EN = {
    "strongly_favor": "prioritize broad reforms that expand rights and public policies",
    "favor": "advance gradual reforms with transparent and measurable goals",
    "neutral": "seek pragmatic balance before expanding structural reforms",
    "against": "maintain institutional stability and avoid abrupt changes without consensus",
    "strongly_against": "preserve the current framework and reject disruptive reforms without strong justification",
}
ENDING_PT, ENDING_EN = "com metas transparentes e revisão periódica.", "with transparent goals and periodic review."
ALSO_PT, MOREOVER_PT, ALSO_EN = "Também considero importante", "Além disso, proponho", "I also consider it important to"

# ---- From a rule: Latin letters with marks and the ASCII letter each decomposes to ----
_FOLD = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(0xC0, 0x250)}
FOLD_FROM = "".join(k for k, v in _FOLD.items() if len(v) == 1)
FOLD_TO = "".join(v for v in _FOLD.values() if len(v) == 1)
