"""Per-document text statistics, and what kind of text a document is.

The statistics are native expressions. The kind comes from an ordered list of rules, induced from
labelled documents by incremental reduced-error pruning (Fuernkranz and Widmer): rules for the rarer
kinds come first and the most frequent kind is the default; every rule is grown condition by
condition on two thirds of the labels that no earlier rule covers, pruned on the other third, and
kept while it is right more often than not. Of several such lists the best is taken (``induce``). The rules are exported as a SQL CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the rules are fitted on, about, where there are more: those whose key's hash is below a threshold.
FIT_ROWS = 20_000

# Frequent words of running sentences that seldom stand in a bare noun phrase, by language.
CLAUSE_WORDS = {
    "pt": "não se já mas porque quando quem há foi é tem vai teve ficou então embora como ninguém mais isso está são também ser foram ter seu sua ele ela nos até cada deve pode era nem ainda onde fica sabe houve haver muito eu nós eles esta este pela pelo",
    "en": "not if but because when who was were is are had has have would will should they we it its their than then been nobody why did does could can i you he she there what where whether since though according must may this these those any",
    "es": "no si pero porque cuando quien hay fue es tiene va tuvo ya entonces aunque nadie más esto está son también ser fueron se su sus él ella nos hasta cada debe puede era ni aún donde queda sabe quedó hace muy yo nosotros ellos esta este aquí según",
}
# Frequent words of noun phrases, by language.
PHRASE_WORDS = {
    "pt": "de do da dos das o a os as e um uma uns umas para por com sem em no na nos nas ao à aos às que sobre entre ou",
    "en": "the of and a an to in for on with by at from as that or about between",
    "es": "de del la el los las y un una unos unas para por con sin en al que sobre entre o",
}

#: Names of the statistics that rules may test, in order.
STATISTICS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "vowel_ratio", "capital_ratio", "odd_ratio", "common_share", "clause_share", "distinct_share", "repeated_share", "separators_per_word", "commas_per_word",
    "clusters_per_word", "inner_marks_per_word", "words_per_line", "punctuated_share", "cell_share", "marker_share", "leader_share", "short_share", "continued_share",
)

_CELLS = r'\|[^|]*\||;[^;\s][^;]{0,60};\S|"[,;]"|(?<=\S) {2,}+\S'
_MARKER = r"^(?:[-–—•*+·▪◦‣]|\[[ xX]?\]|\(?(?:\d{1,3}|[A-Za-z]|[ivx]{1,5})[).ºª°]+)\s+\S"
_LEADER = r"\.{4,}\s*\d*$"
_CONTINUED = r"^\p{Ll}"
_SHORT = r"^\p{Lu}[^,;:!?\t|]{0,69}$"
_VOWELS = "aeiouyáàâãäåæéèêëíìîïóòôõöøúùûüýÿœ"
_CLUSTERS = r"[bcdfghjklmnpqrstvwxzçñ]{4,}|[aeiouáàâãéêíóôõú]{3,}"


def statistics(documents: DataFrame, text: str) -> DataFrame:
    """The other columns of ``documents`` with n_chars and STATISTICS.

    Words are runs of letters. Shares are of words (common, clause, distinct), of pieces between
    marks (repeated), of lines (punctuated) or of the characters in lines (cell, marker, leader,
    short, continued); ratios are of characters. Vowels and clusters (long runs of consonants or
    vowels) are counted in the different words of a text. Tags of list items, table cells and paragraphs count as the
    breaks they stand for. Null counts as empty; a statistic without denominator is 0. Columns of
    ``documents`` that are named like statistics are replaced by them.
    """
    kept = [c for c in documents.columns if c not in (text, "n_chars", *STATISTICS)]
    raw = F.coalesce(F.col(text), F.lit(""))
    items = F.regexp_replace(F.regexp_replace(raw, r"(?i)</t[dh]>\s*<t[dh][^>]*>", "\t"), r"(?i)<li\b[^>]*>", "\n- ")
    broken = F.regexp_replace(items, r"(?i)</?(?:ul|ol|li|table|tbody|thead|tr|td|th|p|div|br|h[1-6])\b[^>]*>", "\n")
    plain = F.when(F.contains(raw, F.lit("<")), broken).otherwise(raw)
    base = documents.select(*kept, plain.alias("_t"))
    trimmed = F.transform(F.split("_t", r"[\r\n]+"), lambda s: F.trim(s))
    base = base.select(
        *kept,
        "_t",
        F.array_remove(trimmed, "").alias("_lines"),
        F.array_remove(F.split(F.lower("_t"), r"[^\p{L}\p{M}]+"), "").alias("_words"),
        F.array_remove(F.split("_t", r"[.!?;|>·/,\t\r\n]+\s*"), "").alias("_parts"),
        F.regexp_replace("_t", r"[\p{Ll}\s\xA0\u2000-\u200B\u3000]+", "").alias("_rest"),
    )
    clause = sorted({w for words in CLAUSE_WORDS.values() for w in words.split()})
    common = sorted({*clause, *(w for words in PHRASE_WORDS.values() for w in words.split())})
    base = base.withColumn("_common", F.filter("_words", lambda w: w.isin(common))).withColumn("_different", F.array_distinct("_words")).withColumn("_spelled", F.array_join("_different", ""))
    length_of = lambda pattern: F.length(F.regexp_replace("_rest", pattern, ""))
    within = lambda test: F.aggregate("_lines", F.lit(0), lambda n, s: n + F.when(test(s), F.length(s)).otherwise(0))
    inside = lambda pattern: within(lambda s: s.rlike(pattern))
    marked = lambda s: s.contains("|") | s.contains(";") | s.contains("  ") | s.contains('","') | s.contains('";"')
    counted = base.select(
        *kept,
        F.length("_t").alias("n_chars"),
        F.size("_words").alias("_w"),
        F.size("_lines").alias("_l"),
        F.size("_parts").alias("_p"),
        F.aggregate("_words", F.lit(0), lambda n, w: n + F.length(w)).alias("_letters"),
        length_of(r"\P{Nd}+").alias("_digits"),
        length_of(r"[\p{L}\p{M}\p{Nd}]+").alias("_symbols"),
        length_of(r"\P{Lu}+").alias("_capitals"),
        length_of(r"[^ÃÂÐÑ¿½€™\uFFFD\p{Cn}\p{Co}\p{Cc}]+").alias("_odd"),
        length_of(r"[^;/·|>]+").alias("_marks"),
        length_of(r"[^,]+").alias("_commas"),
        F.length("_spelled").alias("_spelled_letters"),
        F.length(F.regexp_replace("_spelled", f"[{_VOWELS}]+", "")).alias("_consonants"),
        F.regexp_count(F.array_join("_different", " "), F.lit(_CLUSTERS)).alias("_clusters"),
        F.regexp_count("_t", F.lit(r"[.,;:!?](?<=\p{L}.)(?=\p{L})")).alias("_inner"),
        F.size("_common").alias("_c"),
        F.size(F.filter("_common", lambda w: w.isin(clause))).alias("_cl"),
        F.size("_different").alias("_dw"),
        F.size(F.array_distinct("_parts")).alias("_dp"),
        F.aggregate("_lines", F.lit(0), lambda n, s: n + F.length(s)).alias("_in_lines"),
        F.size(F.filter("_lines", lambda s: F.substring(s, -9, 9).rlike(r"[.!?…:;][\"'”»)]*$"))).alias("_ends"),
        within(lambda s: s.contains("\t") | (marked(s) & s.rlike(_CELLS))).alias("_cells"),
        inside(_MARKER).alias("_markers"),
        within(lambda s: s.contains("....") & s.rlike(_LEADER)).alias("_leaders"),
        inside(_SHORT).alias("_short"),
        inside(_CONTINUED).alias("_continued"),
    )
    counted = counted.withColumn("_black", F.col("_letters") + F.col("_digits") + F.col("_symbols"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    exprs = {
        "n_words": F.col("_w").cast("double"),
        "mean_word_length": ratio("_letters", "_w"),
        "symbol_ratio": ratio("_symbols", "_black"),
        "digit_ratio": ratio("_digits", "_black"),
        "vowel_ratio": F.when(F.col("_spelled_letters") > 0, 1 - F.col("_consonants") / F.col("_spelled_letters")).otherwise(0.0),
        "capital_ratio": ratio("_capitals", "_letters"),
        "odd_ratio": ratio("_odd", "_black"),
        "common_share": ratio("_c", "_w"),
        "clause_share": ratio("_cl", "_w"),
        "distinct_share": ratio("_dw", "_w"),
        "repeated_share": F.when(F.col("_p") > 0, 1 - F.col("_dp") / F.col("_p")).otherwise(0.0),
        "separators_per_word": ratio("_marks", "_w"),
        "commas_per_word": ratio("_commas", "_w"),
        "clusters_per_word": ratio("_clusters", "_dw"),
        "inner_marks_per_word": ratio("_inner", "_w"),
        "words_per_line": ratio("_w", "_l"),
        "punctuated_share": ratio("_ends", "_l"),
        "cell_share": ratio("_cells", "_in_lines"),
        "marker_share": ratio("_markers", "_in_lines"),
        "leader_share": ratio("_leaders", "_in_lines"),
        "short_share": ratio("_short", "_in_lines"),
        "continued_share": ratio("_continued", "_in_lines"),
    }
    return counted.select(*kept, "n_chars", *[exprs[s].alias(s) for s in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """``kind`` if every condition (statistic, is_upper_bound, threshold) holds."""

    kind: str
    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, upper, threshold in self.conditions:
            out &= x[name] <= threshold if upper else x[name] > threshold
        return out

    def sql(self) -> str:
        return " AND ".join(f"{name} {'<=' if upper else '>'} {threshold!r}D" for name, upper, threshold in self.conditions) or "TRUE"


def _grown(x: dict[str, np.ndarray], y: np.ndarray, kind: str) -> Rule:
    """Adds the condition of the largest FOIL gain, of all statistics and all thresholds between their values, until no negative is covered or nothing is gained."""
    rule, inside = Rule(kind, ()), np.ones(len(y), bool)
    orders = {name: np.argsort(values, kind="stable") for name, values in x.items()}
    while True:
        p0, n0 = np.sum(y[inside]), np.sum(~y[inside])
        if not p0 or not n0:
            return rule
        best = (1e-9, None)
        base = np.log2(p0 / (p0 + n0))
        for name, values in x.items():
            order = orders[name][inside[orders[name]]]
            v, positive = values[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p = np.cumsum(positive)[cut].astype(float)
            t = cut + 1.0
            for upper, pp, tt in ((True, p, t), (False, p0 - p, len(v) - t)):
                gain = np.zeros(len(pp))
                np.log2(pp / tt, out=gain, where=pp > 0)
                gain = np.where(pp > 0, pp * (gain - base), 0.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (name, upper, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
        if best[1] is None:
            return rule
        rule = Rule(kind, (*rule.conditions, best[1]))
        inside = rule.covers(x)


def _pruned(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule with the largest (p - n) / (p + n) on the pruning set, and its precision there."""
    best = (-2.0, rule, 0.0)
    for k in range(1, len(rule.conditions) + 1):
        cut = Rule(rule.kind, rule.conditions[:k])
        covered = cut.covers(x)
        p, n = np.sum(y[covered]), np.sum(~y[covered])
        if p + n and (p - n) / (p + n) > best[0]:
            best = ((p - n) / (p + n), cut, p / (p + n))
    return best[1], best[2]


def _induced(x: dict[str, np.ndarray], kinds: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    names, counts = np.unique(kinds, return_counts=True)
    ordered = [str(k) for _, k in sorted(zip(counts.tolist(), names.tolist(), strict=True))]
    left = np.ones(len(kinds), bool)
    rules: list[Rule] = []
    for kind in ordered[:-1]:
        while np.any(kinds[left] == kind):
            at = rng.permutation(np.flatnonzero(left))
            y = kinds == kind
            is_positive = y[at]
            parts = [np.concatenate([g[: -(-2 * len(g) // 3)] for g in (at[is_positive], at[~is_positive])]), np.concatenate([g[-(-2 * len(g) // 3) :] for g in (at[is_positive], at[~is_positive])])]
            grow, prune = parts
            of = lambda rows: {k: v[rows] for k, v in x.items()}
            rule = _grown(of(grow), y[grow], kind)
            if not rule.conditions:
                break
            precision = 1.0
            if np.any(y[prune]):
                rule, precision = _pruned(rule, of(prune), y[prune])
            covered = rule.covers(x) & left
            if precision <= 0.5 or not np.any(covered & y) or np.mean(y[covered]) <= 0.5:
                break
            rules.append(rule)
            left &= ~covered
    return [*rules, Rule(ordered[-1], ())]


def predict(rules: list[Rule], x: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(x.values())))
    out, left = np.full(n, rules[-1].kind, object), np.ones(n, bool)
    for rule in rules:
        hit = rule.covers(x) & left
        out[hit] = rule.kind
        left &= ~hit
    return out


def induce(x: dict[str, np.ndarray], kinds: np.ndarray, seed: int = 0, restarts: int = 60, folds: int = 10) -> list[Rule]:
    """An ordered rule list, the best of several.

    Every list is induced without one fold of the labels and judged by its errors on all of them,
    those of the fold it has not seen included; conditions cost a little. The last rule has no
    condition and is the default. No labels give the default ``prose``.
    """
    if not len(kinds):
        return [Rule("prose", ())]
    fold = np.random.default_rng(seed).permutation(len(kinds)) % folds

    def judged(i: int) -> tuple[float, int, list[Rule]]:
        seen = fold != i % folds if len(kinds) >= folds else np.ones(len(kinds), bool)
        rules = _induced({k: v[seen] for k, v in x.items()}, kinds[seen], np.random.default_rng([seed, i]))
        return float(np.mean(predict(rules, x) != kinds)) + 0.0002 * sum(len(r.conditions) for r in rules), i, rules

    return min(judged(i) for i in range(restarts))[2]


def case_sql(rules: list[Rule]) -> str:
    """The rules as a SQL CASE expression over the statistics."""
    said = lambda kind: "'" + kind.replace("\\", "\\\\").replace("'", "\\'") + "'"
    whens = " ".join(f"WHEN {r.sql()} THEN {said(r.kind)}" for r in rules[:-1])
    return f"CASE {whens} ELSE {said(rules[-1].kind)} END" if whens else said(rules[-1].kind)


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from ``labels`` (key, kind) on the statistics of their documents.

    Keys with several kinds, null kinds and keys without document are left out. Of more than
    ``fit_rows`` labels about so many are used, those whose key's hash is below a threshold, so the
    driver never gets more. Rules may be kept and given to ``kinds`` again: they are plain values.
    """
    known = labels.where(F.col("kind").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("kind").alias("kind"), F.max("kind").alias("_other")).where("kind = _other").drop("_other")
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int((1 << 31) * fit_rows / n))
    rows = statistics(documents.select(key, text).join(F.broadcast(known), key), text).select(key, "kind", *STATISTICS).toPandas().sort_values(key)
    rows = rows.drop_duplicates(key)
    return induce({s: rows[s].to_numpy(float) for s in STATISTICS}, rows["kind"].to_numpy(object).astype(str))


def kinds(documents: DataFrame, rules: list[Rule], text: str) -> DataFrame:
    """``statistics`` with the column kind."""
    return statistics(documents, text).withColumn("kind", F.expr(case_sql(rules)))
