import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hemicycle.llm import split


def own(spark, text):
    df = spark.createDataFrame([(1, text + " x" * 3500, "y")], "Id int, t string, pieces string")
    return [a for r in split.split_plan(df, "Id", "t").collect() for p in r.pieces for a in p.articles]


@pytest.mark.parametrize(
    ("heading", "number"),
    [
        ("<h3>Artigo 1.º</h3>", 1),
        ("<p><b>Art</b><b>igo 12</b>.º</p>", 12),
        ("<p>\n  <u>Artigo n.º 3</u>\n</p>", 3),
        ("\nArt. 4.º - (Âmbito)\n", 4),
        ('<p align="center">ARTIGO 5º – Deveres dos servi&ccedil;os</p>', 5),
        ("<br><br>\nA R T I G O  6.&ordm;<br>", 6),
        ("<h4>ARTIGO XIV</h4>", 14),
        ("<h4>ARTIGO XLIX</h4>", 49),
        ("<p><b>Artigo primeiro</b></p>", 1),
        ("<p><b>Artigo d&eacute;cimo s&eacute;timo</b></p>", 17),
        ("<p><b>ARTIGO VIGÉSIMO QUARTO</b></p>", 24),
        ('<div class="a1"><span>Artigo&nbsp;7.º</span></div>', 7),
        ("\r\nArtigo 8º\r\n", 8),
        ("<p>Artigo 9.º: Objeto</p>", 9),
        ("<P><B>Artigo 1.º</B></P>", 1),
        ("<H3>ARTIGO 2.º</H3>", 2),
        ("<p>Artigo 3.&#186;</p>", 3),
        ("<p>Artigo 4.&#xBA;</p>", 4),
        ("<p>Artigo&#160;5.º</p>", 5),
        ("<BR>Artigo 6.<sup>o</sup><BR>", 6),
        ("<p>ARTIGO D&#201;CIMO PRIMEIRO</p>", 11),
        ("<p>Artigo 7.º - " + "Dos deveres de quem ensina e de quem aprende, " * 8 + "e do mais</p>", 7),
        ("<p>Artigo 8.º (" + "Âmbito (em geral) " * 20 + ")</p>", 8),
        ("<p>x<</p><p>Artigo 10.º</p>", 10),
        ("<input hidden><p>Artigo 12.º</p>", 12),
        ("<p>« x « y</p><p>Artigo 13.º</p>", 13),
        ("&laquo;citado&#187;<p>Artigo 14.º</p>", 14),
    ],
)
def test_headings_however_written(spark, heading, number):
    assert own(spark, f"<p>Texto inicial.</p>{heading}<p>Corpo do artigo.</p>") == [number]


@pytest.mark.parametrize(
    "text",
    [
        "<p>Nos termos do artigo 5.º do regimento.</p>",
        "<p>Artigo 5.º, n.º 2, da lei-quadro mantém a redação que tinha.</p>",
        "<!-- Artigo 9.º: versão retirada -->",
        "<!--\n<h3>Artigo 9.º</h3>\n-->",
        "<p>Índice<br>\nArtigo 1.º ........ 1<br>\nArtigo 2.º (sem conteúdo) ............</p>",
        "<p>passa a ter a seguinte redação:</p>\n«<h3>Artigo 5.º</h3>\n<p>1 - [...]</p>»",
        "\n“Art. 9.º - (Âmbito)\ntexto”\n",
        "<blockquote>\n<h3>Artigo 3.º</h3></blockquote>",
        "<h3>Artigo 5.º-A</h3>",
        '<p style="display: none">\nArtigo 4.º\n</p>',
        "<ul><li>Artigo 5.º</li></ul>",
        "<h3>Arte 5</h3>",
        "<div hidden><div>x</div><h3>Artigo 3.º</h3></div>",
        "<br><p style='visibility:hidden'>Artigo 3.º</p>",
        "<P HIDDEN>\nArtigo 3.º</P>",
        "<p><span hidden>Artigo 3.º</span></p>",
        "&#171;<p>Artigo 3.º</p>&#xBB;",
        "«a «b «<p>Artigo 3.º</p>» c»<p>Artigo 4.º</p>»",
        "<blockquote>a<blockquote>b</blockquote><p>Artigo 3.º</p></blockquote>",
        "<!-- never closed <p>Artigo 3.º</p>",
        "<SCRIPT>\nArtigo 3.º\n</SCRIPT>",
    ],
)
def test_what_is_no_own_heading(spark, text):
    assert own(spark, f"<p>Início.</p>{text}<p>Corpo.</p>") == []


def test_pieces_cover_every_text(spark):
    rng = random.Random(4)
    words = ["de", "bill.", "água;", "<p>x</p>", "\n", "<h3>Artigo 2.º</h3>", "😀", "longword" * 9, "   ", "«a»", "", "&ordm;"]
    texts = ["".join(rng.choice(words) + " " for _ in range(rng.choice([5, 80, 600]))) for _ in range(30)] + ["x" * 2000, "", None, "😀" * 1500]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "Id int, t string, piece_no int")
    got = {}
    for r in split.pieces(df, "Id", "t", 500, 40).orderBy("Id", "piece_no").collect():
        got.setdefault(r.Id, []).append(r)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 500}
    for i, parts in got.items():
        assert parts[0].start == 0 and parts[-1].start + parts[-1].n_chars == len(texts[i])
        for n, p in enumerate(parts):
            assert p.piece_no == n + 1 and p.piece == texts[i][p.start : p.start + p.n_chars] and len(p.piece) <= 500
            if n:
                before = parts[n - 1].start + parts[n - 1].n_chars
                assert p.start == before - min(40, before) and p.piece.startswith(texts[i][max(0, before - 40) : before])


def test_cuts_prefer_strong_boundaries(spark):
    body = "Uma frase curta. " * 20
    cut = lambda t, limit: [t[p.start : p.start + p.length] for r in split.split_plan(spark.createDataFrame([(1, t)], "Id int, t string"), "Id", "t", limit, 0).collect() for p in r.pieces]
    articles = "".join(f"<h3>Artigo {i}.º</h3><p>{body}</p>" for i in range(1, 6))
    assert all(p.startswith("<h3>Artigo") for p in cut(articles, 900))
    assert all(p.endswith("</p>") for p in cut(f"<p>{body}</p>" * 6, 900))
    assert all(p.endswith(". ") for p in cut(body * 6, 900))
    assert {len(p) for p in cut("x" * 1800, 900)} == {900}
    assert all(re.search(r"\s$", p) for p in cut("palavra " * 400, 900)[:-1])


def test_very_long_text_and_bad_parameters(spark):
    long = "<h3>Artigo 1.º</h3><p>" + "a b. " * 200_000 + "</p><p>« never closed</p>\n<h3>Artigo 2.º</h3>"
    assert own(spark, long) == [1, 2]
    with pytest.raises(ValueError):
        split.split_plan(spark.createDataFrame([], "Id int, t string"), "Id", "t", 10, 10)


@pytest.mark.parametrize("unit", ["&laquo; x ", "<a b ", "<!-- x ", "<br>", "« x ", "««a» ", "<p hidden>x ", "<div hidden><div>", "<blockquote>x ", "\n", "<p>A<b>", "\nArtigo 5 (b ", "“ «", "< ", "<script>"])
def test_time_follows_length(spark, unit):
    """Openings without end, and runs of what may come before a heading: four times the text takes nothing like sixteen times as long."""
    seconds = []
    for n in (500_000, 500_000, 2_000_000):
        df = spark.createDataFrame([(1, (unit * (n // len(unit) + 1))[:n])], "Id int, t string")
        began = time.perf_counter()
        assert [len(r.pieces) > n // 6000 for r in split.split_plan(df, "Id", "t").collect()] == [True]
        seconds.append(time.perf_counter() - began)
    assert seconds[2] < 10 and seconds[2] < 8 * max(seconds[1], 0.3)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 16, 17, 1000])
def test_offsets_are_prefix_sums(spark, n):
    lengths = [(7 * i) % 11 for i in range(n)]
    df = spark.createDataFrame([(lengths,)], "x array<int>")
    assert df.select(split._starts(F.col("x")).alias("s")).first().s == [sum(lengths[:i]) for i in range(n)]


def test_empty_table(spark):
    assert split.pieces(spark.createDataFrame([], "Id int, t string"), "Id", "t").count() == 0
