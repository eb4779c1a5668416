"""Addresses of pages: host rules first, then boosted trees on lexical features learnt from what the rules decide."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
FEATURES = ("url_length", "host_length", "host_labels", "path_depth", "digit_ratio", "entropy", "n_parameters", "has_fragment", "suffix_share", "suffix_pages", "section_share", "section_pages")
# The last label of the host, and that with the first step of the path.
GROUPS = ("suffix", "section")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict); null if none does."""
    fits = []
    for verdict, rule in rules:
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        here = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def lexical(frame: DataFrame) -> DataFrame:
    """Adds what the address itself tells: length, depth, digits, entropy of characters, parameters."""
    url, size = F.coalesce("url", F.lit("")), F.length(F.coalesce("url", F.lit("")))
    letters = F.array_distinct(F.split(url, ""))
    times = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda total, c: total - times(c) * F.log2(times(c)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return frame.withColumns({
        "url_length": size.cast("double"), "host_length": F.length("host").cast("double"), "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "path_depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
        "digit_ratio": F.when(size > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / size).otherwise(0.0),
        "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "n_parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "has_fragment": F.when(F.contains(url, F.lit("#")), 1.0).otherwise(0.0),
        "suffix": F.element_at(F.split("host", r"\."), -1),
        "section": F.concat(F.element_at(F.split("host", r"\."), -1), F.lit("/"), F.regexp_extract("path", r"\A/([^/]*)", 1)),
    })


def learn_addresses(labelled: DataFrame, most_examples: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 7) -> Callable[[DataFrame], DataFrame]:
    """Boosted trees from addresses with lexical features and a 0/1 ``label``, both labels present, as a function that adds ``prediction`` and ``probability``.

    Copies of an address are one; of each label the ``most_examples`` / 2 with the least hash are learnt from. An address leaves its own
    label out of the statistics of its suffix and section, so the trees learn what these tell about other addresses.
    """
    known = cut_lineage(labelled.select("url", "label", *GROUPS, *[f for f in FEATURES if not f.startswith(GROUPS)]).dropDuplicates(["url"]))
    totals = known.agg(F.count("label").alias("n"), F.sum("label").alias("blocked")).first()
    overall = totals["blocked"] / totals["n"]
    taken = None
    for label in (0.0, 1.0):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(most_examples // 2)
        taken = some if taken is None else taken.unionByName(some)
    statistics = {}
    for group in GROUPS:
        counted = cut_lineage(known.groupBy(group).agg(F.count("label").alias("n"), F.sum("label").alias("blocked")))
        statistics[group] = counted.select(group, *_share(group, F.col("blocked"), F.col("n"), overall))
        own = _share(group, F.col("blocked") - F.col("label"), F.col("n") - 1, overall)
        taken = taken.join(counted, group).select(*taken.columns, *own)
    trees_of = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, checkpointInterval=-1)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees_of]).fit(taken.select("label", *FEATURES))

    def judge(rows: DataFrame) -> DataFrame:
        for group, shares in statistics.items():
            rows = rows.join(shares, group, "left").fillna({f"{group}_pages": 0.0, f"{group}_share": overall})
        return model.transform(rows)

    return judge


def _share(group: str, blocked: Column, n: Column, overall: float) -> list[Column]:
    return [F.log1p(n).alias(f"{group}_pages"), ((blocked + 10 * overall) / (n + 10)).alias(f"{group}_share")]


def judge_urls(pages: DataFrame, url: str = "url", by: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str]] = RULES, most_examples: int = 20_000,
               trees: int = 10, depth: int = 4, seed: int = 7) -> DataFrame:
    """``by``, ``host``, ``path``, ``rule`` and ``verdict`` of every page's address, and ``score``, the chance of block.

    Rules fit a host with its subdomains and the start of the path; the longest decides. Where none fits, boosted
    trees do: they learn from the addresses that rules decide (``most_examples`` at most, half of each verdict).
    Suffix statistics are the number of decided addresses under the last label of the host, and under it with the first step of the path, and their
    share of blocks, drawn towards the overall share. If rules decide nothing, the rest is allowed; if they only ever give one
    verdict, so does the rest. A null address, or one without ``://``, has an empty host and path and no rule.
    Repeated rows stay. The library's records name no addresses, so this works on any table that has some.
    """
    rows = pages.select(*by, F.col(url).cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = lexical(rows).withColumn("__fit", decided(F.col("host"), F.col("path"), rules)).withColumn("label", F.when(F.col("__fit.verdict") == "block", 1.0).when(F.col("__fit").isNotNull(), 0.0))
    totals = rows.agg(F.count("label").alias("n"), F.sum("label").alias("blocked")).first()
    shown = [*by, "host", "path", F.col("__fit.rule").alias("rule")]
    if not totals["n"] or totals["blocked"] in (0, totals["n"]):
        only = "block" if totals["n"] and totals["blocked"] else "allow"
        return rows.select(*shown, F.coalesce("__fit.verdict", F.lit(only)).alias("verdict"), F.coalesce("label", F.lit(1.0 if only == "block" else 0.0)).alias("score"))
    judged = learn_addresses(rows.where("label IS NOT NULL"), most_examples, trees, depth, seed)(rows)
    score = F.coalesce("label", vector_to_array("probability")[1])
    return judged.select(*shown, F.coalesce("__fit.verdict", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
