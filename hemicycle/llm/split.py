"""Splitting oversized bills at natural boundaries.

Regular expressions do the work. One pass goes from heading to heading of the bill's own articles;
it steps over what a reader cannot see and what the text quotes from other laws, so that no heading
is found in them. The headings are marked in place, which keeps every offset. Then an expression with
bounded quantifiers consumes the marked text piece by piece, its alternatives ordered by the strength
of the boundary, with a plain character count as the last one. Pieces are offsets until the end; the
overlap is a look back in the text as stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the first character of an own article's heading.
MARK = ""

# Portuguese ordinals, as written without accents.
ORDINALS = {
    "primeiro": 1, "segundo": 2, "terceiro": 3, "quarto": 4, "quinto": 5, "sexto": 6, "setimo": 7, "oitavo": 8, "nono": 9, "decimo": 10,
    "vigesimo": 20, "trigesimo": 30, "quadragesimo": 40, "quinquagesimo": 50, "sexagesimo": 60, "septuagesimo": 70, "octogesimo": 80, "nonagesimo": 90, "centesimo": 100,
}
# Roman digits, and the pairs whose first digit is subtracted.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000, "IV": -2, "IX": -2, "XL": -20, "XC": -20, "CD": -200, "CM": -200}

_TAG = r"[^<>]*+>"
_HIDES = r"(?=[^<>]*?(?:\shidden\b|display\s*+:\s*+none|visibility\s*+:\s*+hidden))"
_LINE_TAGS = r"(?i:p|div|h[1-6]|section|article|header|center)\b"
_BLOCK = r"(?i:p|div|h[1-6]|ol|ul|table|blockquote|section|article|header|center)"
_INLINE = rf"</?(?i:b|i|u|em|strong|span|font|a|small|big|sup)\b(?!{_HIDES}){_TAG}"
_VOID = r"(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b"
_NBSP = r"&(?:nbsp|#160|#[xX]0*[aA]0);"
_GAP = rf"(?:[ \t\x0B\f\xA0]|{_NBSP}|{_INLINE})*+"


def _mark(plain: str, name: str, code: int) -> str:
    """A character as itself, by its name or by its number."""
    return rf"(?:{plain}|&(?:{name}|#{code}|#[xX](?i:{code:x}));)"


def _quotation(opens: str, closes: str, entity: str, marks: str) -> str:
    """A quotation with quotations in it, three deep. An opening mark without partner fails at the third mark after it at the latest."""
    text = rf"[^{marks}&]*+(?:&(?!{entity})[^{marks}&]*+)*+"
    out = rf"{opens}{text}{closes}"
    for _ in range(2):
        out = rf"{opens}{text}(?:{out}{text})*+{closes}"
    return out


def _element(opening: str, name: str) -> str:
    """An element with elements of its name in it, two deep; else up to the next closing tag, or to the end, where HTML closes what is open."""
    text, closing = rf"(?:(?!</?{name}\b).)*+", rf"</{name}\s*+>"
    return rf"{opening}(?:{text}(?:<{name}\b{_TAG}{text}{closing}{text})*+{closing}|.*?(?:{closing}|\z))"


_ANGLE, _CURLY = r"(?:[lr]aquo|#1[78][17]|#[xX](?i:ab|bb));", r"(?:[lr]dquo|#822[01]|#[xX](?i:201[cd]));"
_UNSEEN = "|".join([
    r"<!--.*?(?:-->|\z)",
    r"(?i:<(?<raw>script|style|template)\b.*?(?:</\k<raw>\s*+>|\z))",
    f"(?i:{_element(rf'<(?<hid>(?!{_VOID})\w++){_HIDES}{_TAG}', r'\k<hid>')})",
])
_QUOTED = "|".join([
    f"(?i:{_element(rf'<blockquote\b{_TAG}', 'blockquote')})",
    _quotation(_mark("«", "laquo", 171), _mark("»", "raquo", 187), _ANGLE, "«»"),
    _quotation(_mark("“", "ldquo", 8220), _mark("”", "rdquo", 8221), _CURLY, "“”"),
])
_AFTER = rf"(?:\A|(?<=[»”]|&r[ad]quo;|&#187;|&#8221;)|(?<=</{_BLOCK}>)|(?<=<(?i:br)\s?/?>))"
_OPENS = rf"(?=[\r\n]|<{_LINE_TAGS}(?!{_HIDES}){_TAG})"
_BETWEEN = rf"(?:\s|\xA0|{_NBSP}|{_INLINE}|<(?:(?i:br)\b|{_LINE_TAGS})(?!{_HIDES}){_TAG})"
_WORD = _GAP.join(["[Aa]", "[Rr]", "[Tt]", rf"(?:{_GAP.join(['[Ii]', '[Gg]', '[Oo]'])}|\.)?"])
_SIGN = r"(?:[ºª°]|(?i:&(?:ordm|ordf|deg|#170|#176|#186|#xaa|#xb0|#xba);)|[oa](?=\s?</(?i:sup)>))"
_ACUTE = r"(?:[eéÉ]|&(?:eacute|#233|#201|#xe9|#xc9);)"
_ORDINAL = "(?:" + "|".join(w.replace("e", _ACUTE) for w in sorted(ORDINALS, key=len, reverse=True)) + ")"
_NUMBER = rf"(?:\d{{1,4}}+(?!\d)|(?i:{_ORDINAL}(?:[ \xA0-]{_ORDINAL}){{0,2}})(?!\p{{L}})|[IVXLCDM]{{1,9}}+(?!\p{{L}}))"
_BEFORE_NUMBER = rf"{_BETWEEN}*+{_WORD}{_GAP}(?:[Nn]\.?{_GAP}(?:{_SIGN}|o){_GAP})?"
_REST_OF_LINE = r"[^<>\r\n.;&]*+(?:&#?\w{2,8};[^<>\r\n.;&]*+)*+"
_TITLE = rf"(?:{_GAP}[-–—:.]?{_GAP}(?:\({_REST_OF_LINE}(?<=\)[ \t\xA0]{{0,9}})|(?:&#?\w{{2,8}};|\p{{Lu}}){_REST_OF_LINE}))?"
_LINE_END = rf"(?={_GAP}(?:[\r\n]|</?{_BLOCK}\b|<(?i:[bh]r)\b|\z))"
_HEADING = rf"(?:{_AFTER}|{_OPENS}){_BEFORE_NUMBER}{_NUMBER}{_GAP}(?:\.?{_GAP}{_SIGN})?+(?!-\p{{Lu}}\b){_TITLE}{_GAP}\.?{_LINE_END}"
# What stands between two lines is passed over at one go: where no heading begins at its start, none begins in it.
_RUN = rf"(?:{_AFTER}|{_OPENS}){_BETWEEN}++"
_TEXT = rf"[^<«“&\r\n]*+(?:&(?!{_ANGLE}|{_CURLY})[^<«“&\r\n]*+)*+"
_PASSED = rf"</?\w{_TAG}|(?=[^<«“\r\n])(?!&(?:{_ANGLE}|{_CURLY})){_TEXT}|."
#: Everything up to a heading, and the heading; at last what follows the last heading, and nothing.
_TO_HEADING = rf"(?s)(?<before>(?:{_UNSEEN}|{_QUOTED}|(?!{_HEADING})(?:{_RUN}|{_PASSED}))*+)(?<heading>{_HEADING}|\z)"

_PARAGRAPH_END = r"(?<=[>\n])(?<=</(?i:p|div|li|ol|ul|tr|table|blockquote|h[1-6])>|<(?i:br)\s?/?>|\n)(?!\n)"
_SENTENCE_END = r"(?<=[\s\xA0])(?<=[.!?;…][\"'”»)]?[\s\xA0])"


def article_number(written: Column) -> Column:
    """The number of an article from digits, Roman digits or Portuguese ordinals."""
    roman = sum((F.regexp_count(written, F.lit(d)) * v for d, v in ROMAN.items()), F.lit(0))
    plain = F.translate(F.lower(F.regexp_replace(written, f"(?i){_ACUTE}", "e")), "êè", "ee")
    values = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    words = F.aggregate(F.split(plain, r"[\s\xA0-]+"), F.lit(0), lambda total, w: total + F.coalesce(values[w], F.lit(0)))
    return F.when(written.rlike(r"^\d+$"), F.try_to_number(written, F.lit("9999")).cast("int")).when(written.rlike("^[IVXLCDM]+$"), roman).otherwise(words).cast("int")


def _pieces_pattern(limit: int, overlap: int) -> str:
    """Consumes the marked text; the first piece has room for ``limit`` characters, others for the limit without the overlap."""

    def upto(n: int) -> str:
        some = f".{{1,{n}}}"
        return "|".join([some + r"+\z", rf"{some}(?={MARK})", some + _PARAGRAPH_END, some + _SENTENCE_END, some + r"(?<=[\s\xA0])", some])

    return rf"(?s)\A(?:{upto(limit)})|{upto(limit - overlap)}"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column) -> Column:
    """Offsets from the lengths of consecutive parts. An array grows by copying, so the sums are taken within rows of about the root of their number, and over the rows."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    add = lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))
    sums = lambda values: F.aggregate(values, first, add, lambda s: s["starts"])

    def by_rows(known: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(known))).cast("int")
        rows = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(known) / width).cast("int") - 1, F.lit(0))), lambda i: F.slice(known, i * width + 1, width))
        totals = F.transform(rows, lambda row: F.aggregate(row, F.lit(0), lambda total, n: total + n))
        return F.flatten(F.zip_with(rows, sums(totals), lambda row, before: F.transform(sums(row), lambda at: at + before)))

    return F.when(F.size(lengths) > 0, _let(lengths, by_rows)).otherwise(F.array().cast("array<int>"))


def split_plan(texts: DataFrame, key: str, text: str, limit: int = 6000, overlap: int = 300) -> DataFrame:
    """key, text, and pieces: array<struct<piece_no, start, length, articles>> of texts with more than ``limit`` characters.

    ``start`` and ``length`` (code points, from 0) are the part of the text that is new in the
    piece; a piece is that part with the ``overlap`` characters before it. Parts are consecutive and
    cover the text. A part ends before an own article's heading if one begins in reach, else after a
    paragraph, a sentence, a word, or at the limit. ``articles`` are the numbers of own articles whose
    heading begins in the part: up to four decimal digits, nine Roman ones, or three ordinal words.
    Null, empty and shorter texts yield no row. An opening quotation mark without its partner quotes
    nothing; an element or a comment that is never closed ends with the text, as in HTML. The time is
    in proportion to the length, whatever is left open.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    plain = F.translate(F.col(text), MARK, " ")
    inserted = F.rtrim(F.regexp_replace(plain, F.lit(_TO_HEADING), F.lit("${before}" + MARK + "${heading}")), F.lit(MARK))
    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"{MARK}{_BEFORE_NUMBER}({_NUMBER})"), F.lit(1)), article_number)
    parts = lambda x: F.transform(
        F.regexp_extract_all(F.regexp_replace(x, f"(?s){MARK}.", MARK), F.lit(_pieces_pattern(limit, overlap)), F.lit(0)),
        lambda p: F.struct(F.length(p).alias("length"), (F.length(p) - F.length(F.replace(p, F.lit(MARK)))).alias("headings")),
    )
    read = _let(inserted, lambda x: F.struct(numbers(x).alias("numbers"), parts(x).alias("parts")))
    placed = _let(read, lambda r: F.struct(r["numbers"].alias("numbers"), r["parts"].alias("parts"), _starts(r["parts"]["length"]).alias("starts"), _starts(r["parts"]["headings"]).alias("firsts")))

    def numbered(r: Column) -> Column:
        def piece(part: Column, i: Column) -> Column:
            articles = F.slice(r["numbers"], F.get(r["firsts"], i) + 1, part["headings"])
            return F.struct((i + 1).alias("piece_no"), F.get(r["starts"], i).alias("start"), part["length"].alias("length"), articles.alias("articles"))

        return F.transform(r["parts"], piece)

    return texts.where(F.length(text) > limit).select(key, text, _let(placed, numbered).alias("pieces"))


def pieces(texts: DataFrame, key: str, text: str, limit: int = 6000, overlap: int = 300) -> DataFrame:
    """The pieces themselves: key, piece_no, start, n_chars, articles, piece. Keys with several rows yield the pieces of each row."""
    exploded = split_plan(texts, key, text, limit, overlap).select(key, text, F.explode("pieces").alias("p"))
    back = F.least(F.col("p.start"), F.lit(overlap))
    return exploded.select(key, "p.piece_no", (F.col("p.start") - back).alias("start"), (F.col("p.length") + back).alias("n_chars"), "p.articles", F.substr(F.col(text), F.col("p.start") - back + 1, F.col("p.length") + back).alias("piece"))
