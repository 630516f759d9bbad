import json

import pytest

from tidewire.sources import pages as H

LONG = "Texto longo que basta para contar como o corpo de uma notícia inteira, com mais de cem caracteres ao todo, sim. "


@pytest.mark.parametrize("mark", ["<article>", "<div role='main'>", "<main>", "<div class='x post-content'>", "<div class='article-content'>", "<div class='article-body'>", "<div class='entry-content'>", "<section class='content'>", "<div id='content'>"])
def test_each_container_holds_the_text(mark):
    tag = mark[1:-1].split()[0]
    html = f"<html><head><title>T</title></head><body><div>Fora</div>{mark}<nav>menu</nav>{LONG}<p>Fim<script>x()</script></{tag}><div class='news'>{LONG}</div></body></html>"
    assert H.main_text(html) == " ".join(f"{LONG} Fim".split())


def test_containers_in_order_and_only_the_first_element():
    one, two = LONG + "um", LONG + "dois"
    assert H.main_text(f"<article>{one}</article><article>{two}</article>") == one
    assert H.main_text(f"<article>curto</article><article>{two}</article><div id=content>{one}</div>") == one
    assert H.main_text(f"<div class=content>{two}</div><div role=main>{one}</div>") == one
    assert H.main_text(f"<aside><article>{one}</article></aside><main>{two}</main>") == two
    assert H.main_text("<head><title>T</title></head><body>a<header>b</header><p>c") == "a c"
    assert H.main_text("<title>T</title>só <b>isto</b>") == "só isto"
    assert H.main_text(None) == "" and H.main_text("") == ""


BASE = "https://site.example.org/a/"


def rung(html, base=BASE):
    return H.link_ladder(base, html)


def ld(value):
    return f"<script type='application/ld+json'>{json.dumps(value)}</script>"


def test_rungs_of_the_link_ladder():
    og = "<meta property='og:title' content=' O  título '><meta property='og:url' content='/og'>"
    nodes = {"@graph": [{"@type": ["Thing", "NewsArticle"], "url": "1", "headline": "Um"}, {"@type": "article", "mainEntityOfPage": {"@id": "/2"}, "name": "Dois"}, {"@type": "Article", "mainEntityOfPage": "/3", "headline": 7, "name": "Três"}, {"@type": "NewsArticle", "url": "1", "headline": "Outra vez"}, {"@type": "BlogPosting", "url": "x", "headline": "Não"}, {"@type": "Article", "url": "/4"}]}
    assert rung(ld(nodes) + og) == (1, [(BASE + "1", "Um"), ("https://site.example.org/2", "Dois"), ("https://site.example.org/3", "Três")])
    assert rung(ld({"@type": "Article", "url": "/4"}) + "<script type='application/ld+json'>{bad</script>" + og) == (2, [("https://site.example.org/og", "O título")])
    html = (
        "<nav><a href='/2026/x'>Ano</a></nav><article><h3><a href='n1'>Um <b>grande</b></a></h3><a href='n2'><img src=x></a><a>sem</a></article>"
        "<h2>Título <a href='h2'></a></h2><h3><p><a href='h3'>Três</a><a href='h3b'>não</a></p></h3><h1><a href='h1'>não</a></h1>"
        "<a href='/Noticia/9'>Nove</a><a href='/news'>Novas</a><a href='/artigos/1'>não</a><a href='n1'>de novo</a>"
    )
    root = "https://site.example.org"
    assert rung(html) == (3, [(BASE + "n1", "Um grande"), (BASE + "h2", "Título"), (BASE + "h3", "Três"), (root + "/2026/x", "Ano"), (root + "/Noticia/9", "Nove"), (root + "/news", "Novas")])
    assert rung("<h2></h2><h1>x</h1>") == (0, [])
    assert rung("<link rel='canonical' href='/c'><p><h2>Título</h2>") == (4, [(root + "/c", "Título")])
    assert rung("<h1>Título</h1>") == (4, [(BASE, "Título")])
    assert rung("<h1>Título</h1>", None) == (0, []) and rung(None) == (0, [])
    assert rung("<article><a href='http://[bad'>x</a></article><h1>T</h1>") == (4, [(BASE, "T")])
