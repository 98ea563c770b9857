"""Queries of the language-data operators on the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hemicycle.functions.keys import letters_and_digits
from hemicycle.llm import mixing, packing, pairs, quality, split, tokens
from hemicycle.session import materialise, spread
from hemicycle.sources.tables import read_table

#: Tokens of a container.
CAPACITY = 2048


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "proposals", "Id", "ProposalTextHTML").where(F.length("ProposalTextHTML") > 6000), "Id")


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, d, "documents", "doc_id", "text", *columns), "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Own articles at which an oversized proposal can be divided, from the parts that the splitting assigns them to."""
    plan = split.split_plan(_oversized(spark, d), "Id", "ProposalTextHTML")
    articles = plan.select("Id", F.explode(F.flatten(F.col("pieces.articles"))).alias("article_no"))
    return articles.select(F.col("Id").alias("proposal_id"), "article_no").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the oversized proposals; equal rows of a proposal are one."""
    once = _oversized(spark, d).groupBy("Id", F.xxhash64("ProposalTextHTML").alias("content")).agg(F.first("ProposalTextHTML").alias("ProposalTextHTML"))
    return split.pieces(once, "Id", "ProposalTextHTML").withColumnRenamed("Id", "proposal_id")


def p2_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each proposal put together again: length and hash of the text, and whether every piece keeps the limit and begins with the end of the one before."""
    order = Window.partitionBy("proposal_id").orderBy("piece_no")
    back = F.least(F.lit(300), F.coalesce(F.lag(F.col("start") + F.col("n_chars")).over(order), F.lit(0)))
    pieces = p2_pieces(spark, d).withColumn("_back", back).withColumn("_before", F.lag("piece").over(order))
    linked = pieces.withColumn("_linked", F.coalesce(F.right("_before", F.col("_back")) == F.left("piece", F.col("_back")), F.col("piece_no") == 1))
    part = F.struct("piece_no", F.substr("piece", F.col("_back") + 1).alias("new"))
    whole = linked.groupBy("proposal_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), (F.max(F.length("piece")) <= 6000).alias("within_limit"), F.bool_and("_linked").alias("overlapping"))
    joined = whole.withColumn("text", F.array_join(F.col("parts.new"), ""))
    return joined.select("proposal_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "within_limit", "overlapping")


def _party_items(spark: SparkSession, d: str) -> DataFrame:
    blocks = read_table(spark, d, "voting_blocks", "VotingResultId", "politicalPartyAcronym", "votingOrientation")
    item = F.concat(letters_and_digits(F.col("politicalPartyAcronym")), F.lit(":"), F.col("votingOrientation").cast("string"))
    return blocks.select("VotingResultId", item.alias("item"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of party positions in a common voting result, with counts and lift."""
    return pairs.pair_counts(_party_items(spark, d), "VotingResultId", "item")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of party positions that occur together clearly more often than by chance."""
    counted = pairs.pair_counts(_party_items(spark, d), "VotingResultId", "item", least=5, share=200)
    return pairs.clearly_together(counted, least=5, share=200).select("item_a", "item_b")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents, or pieces of those above the capacity, with their containers."""
    sized = tokens.token_counts(_texts(spark, d), "text")
    return packing.pack(materialise(sized, "document_tokens"), "doc_id", CAPACITY)


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least possible number, and the share of their room that is used."""
    return packing.packing_summary(p6_containers(spark, d), CAPACITY)


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents in containers, and how many containers are too full, pieces overlap, and documents are divided without need or not covered by their pieces."""
    packed = p6_containers(spark, d)
    end = F.col("container_offset") + F.col("n_tokens")
    reached = F.max(end).over(Window.partitionBy("container_id").orderBy("container_offset", "n_tokens", "doc_id", "piece_no").rowsBetween(Window.unboundedPreceding, -1))
    containers = packed.withColumn("_hits", (reached > F.col("container_offset")).cast("int")).groupBy("container_id").agg(F.max(end).alias("fill"), F.sum("n_tokens").alias("used"), F.sum("_hits").alias("hits"))
    documents = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("covered"))
    full = containers.agg(F.count_if((F.col("fill") > CAPACITY) | (F.col("used") > CAPACITY)).alias("n_too_full"), F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("n_overlaps"))
    whole = documents.agg(F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= CAPACITY)).alias("n_divided"), F.count_if(F.col("covered") != F.col("tokens")).alias("n_uncovered"))
    return whole.withColumn("_one", F.lit(1)).join(full.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents weigh by three statistics of problem 8 that hold in any language: the less they consist of symbols, of digits and of repeated pieces, the more. Texts without words weigh least."""
    documents = _texts(spark, d, "source").withColumn("body", F.col("text"))
    judged = quality.statistics(documents, "body").select("doc_id", "source", "text", "n_words", "symbol_ratio", "digit_ratio", "repeated_share")
    clean = (1 - F.col("symbol_ratio")) * (1 - F.col("digit_ratio")) * (1 - F.col("repeated_share"))
    weighted = judged.select("doc_id", "source", "text", F.when(F.col("n_words") > 0, F.greatest(clean, F.lit(0.05))).otherwise(0.05).alias("weight"))
    return mixing.mix(materialise(tokens.token_counts(weighted, "text"), "document_weights"), read_table(spark, d, "mix_targets"), "doc_id")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each mix with their number of uses."""
    return _mix(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each mix and source."""
    return mixing.mix_report(*_mix(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short of their target in the selection that was made, though it takes all that it may."""
    return p7_report(spark, d).where("not reachable").select("mix_id", "source")


def _rules(spark: SparkSession, d: str) -> list[quality.Rule]:
    return quality.fit(read_table(spark, d, "documents", "doc_id", "text"), read_table(spark, d, "doc_labels", "doc_id", "kind"), "doc_id", "text")


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules that the labelled documents give, in order."""
    rules = [(i + 1, r.kind, r.sql()) for i, r in enumerate(_rules(spark, d))]
    return spark.createDataFrame(rules, "rule_no int, kind string, condition string")


def p8_statistics(spark: SparkSession, d: str, rules: list[quality.Rule] | None = None) -> DataFrame:
    """The statistics of every document and its kind, by given rules or by those that the labelled documents give; given rules save one reading of the texts."""
    return quality.kinds(_texts(spark, d), rules or _rules(spark, d), "text")


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of words and lines alone."""
    counted = quality.statistics(_texts(spark, d), "text")
    return counted.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), "mean_word_length", "common_share", "clause_share", "distinct_share", "words_per_line")


def p8_found(spark: SparkSession, d: str, rules: list[quality.Rule] | None = None) -> DataFrame:
    """Documents that are not natural prose."""
    kind = F.col("kind")  # a generator, so that the statistics are not computed again for a filter pushed below them
    return p8_statistics(spark, d, rules).select("doc_id", F.explode(F.when(kind != "prose", F.array(kind)).otherwise(F.array().cast("array<string>"))).alias("kind"))


_ITEMS = """with blocks as (
  select distinct VotingResultId as basket, concat(regexp_replace(upper(strip_accents(politicalPartyAcronym)), '[^\\p{L}\\p{Nd}]', '', 'g'), ':', votingOrientation) as item
  from voting_blocks where VotingResultId is not null and politicalPartyAcronym is not null and votingOrientation is not null),
total as (select count(distinct basket) as n_baskets from blocks),
single as (select item, count(*) as n from blocks group by item),
joint as (select a.item as item_a, b.item as item_b, count(*) as n_both from blocks a join blocks b on a.basket = b.basket and a.item < b.item group by 1, 2),
pairs as (
  select item_a, item_b, n_both, x.n as n_a, y.n as n_b, n_baskets, n_both * n_baskets / (cast(x.n as double) * y.n) as lift
  from joint join single x on x.item = item_a join single y on y.item = item_b cross join total)
"""


def _word_list(*lists: dict[str, str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted({w for words in lists for one in words.values() for w in one.split()}))


#: Any measure of size gives the same cases; here it is characters.
_UNREACHABLE = """with docs as (select lower(regexp_replace(source, '^[\\s\\p{Z}\\x{200B}\\x{FEFF}]+|[\\s\\p{Z}\\x{200B}\\x{FEFF}]+$', '', 'g')) as source_key, length(text) as n from documents),
sizes as (select source_key, sum(n) as available from docs where source_key is not null group by 1),
wanted as (select distinct mix_id, size_factor, source, greatest(coalesce(target_weight, 0), 0) as w, max_repeats, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) as source_key from mix_targets),
targets as (select *, w / sum(w) over (partition by mix_id) * size_factor * (select sum(n) from docs) as target from wanted)
select mix_id, source from targets left join sizes using (source_key) where target > 0 and target > coalesce(available, 0) * coalesce(max_repeats, 1)"""

_WORD_COUNTS = f"""with plain as (select doc_id, case when contains(coalesce(text, ''), '<') then regexp_replace(regexp_replace(regexp_replace(text, '(?i)</t[dh]>\\s*<t[dh][^>]*>', chr(9), 'g'), '(?i)<li\\b[^>]*>', chr(10) || '- ', 'g'), '(?i)</?(?:ul|ol|li|table|tbody|thead|tr|td|th|p|div|br|h[1-6])\\b[^>]*>', chr(10), 'g') else coalesce(text, '') end as t from documents),
parted as (select doc_id, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{M}}]+'), lambda w: w <> '') as words, list_filter(list_transform(regexp_split_to_array(t, '[\\r\\n]+'), lambda l: trim(l, ' ')), lambda l: l <> '') as lines from plain),
counted as (select doc_id, len(words) as w, len(lines) as l, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as letters, len(list_distinct(words)) as dw, len(list_filter(words, lambda w: w in ({_word_list(quality.CLAUSE_WORDS, quality.PHRASE_WORDS)}))) as c, len(list_filter(words, lambda w: w in ({_word_list(quality.CLAUSE_WORDS)}))) as cl from parted)
select doc_id, w as n_words, coalesce(letters / nullif(w, 0), 0.0)::double as mean_word_length, coalesce(c / nullif(w, 0), 0.0) as common_share, coalesce(cl / nullif(w, 0), 0.0) as clause_share, coalesce(dw / nullif(w, 0), 0.0) as distinct_share, coalesce(w / nullif(l, 0), 0.0) as words_per_line from counted"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_pieces, p2_round_trip, p4_found, p4_pairs, p6_containers, p6_summary, p6_checks, p7_found, p7_report, p7_selection, p8_found, p8_rules, p8_statistics, p8_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_round_trip": "select distinct Id as proposal_id, length(ProposalTextHTML) as n_chars, sha256(ProposalTextHTML) as hash, true as within_limit, true as overlapping from proposals where length(ProposalTextHTML) > 6000",
        "p4_found": _ITEMS + "select item_a, item_b from pairs where n_both >= 5 and n_both * 200 >= n_baskets and n_both * n_baskets >= 3 * n_a * n_b",
        "p4_pairs": _ITEMS + "select * from pairs",
        "p6_checks": "select count(*) as n_documents, 0 as n_divided, 0 as n_uncovered, 0 as n_too_full, 0 as n_overlaps from documents",
        "p7_found": _UNREACHABLE,
        "p8_counts": _WORD_COUNTS,
    }
