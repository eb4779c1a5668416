"""Two readers of one page: comparison, repair and voting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.numbers import lower_median
from folioframe.plans.greedy import greedy_keep
from folioframe.plans.spatial import (
    PAGE, Box, best_partner, box, box_of, near_join, share, share_either, touches, vertical_share,
    without_partner,
)
from folioframe.session import cut_lineage

LETTER_OR_DIGIT = r"[\p{L}\p{N}]"


def valid_boxes(token: DataFrame, page: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Non-empty text with a finite, positive box inside the page (one pixel of slack)."""
    b = box()
    finite = F.lit(True)
    for value in (b.x, b.y, b.w, b.h):
        finite = finite & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    sized = token.join(page.select(*by, "page_w", "page_h"), list(by))
    return sized.where(
        (F.trim("text") != "") & finite & (b.x >= 0) & (b.y >= 0) & (b.w > 0) & (b.h > 0)
        & (b.right <= F.col("page_w") + 1) & (b.bottom <= F.col("page_h") + 1)
    ).drop("page_w", "page_h")


def reading_order_in_lines(words: Column) -> Column:
    """Array of word structs (``line``, ``x``, ``y``, ``ord``...) by line top, then x."""
    def keyed(e: Column) -> Column:
        top = F.array_min(F.transform(F.filter(words, lambda z: z["line"] == e["line"]), lambda z: z["y"]))
        return F.struct(top.alias("top"), e["line"].alias("line"), e["x"].alias("x"), e["ord"].alias("ord"),
                        e.alias("word"))

    return F.transform(F.array_sort(F.transform(words, keyed)), lambda k: k["word"])


def lines_to_text(ordered: Column, field: str = "text") -> Column:
    lines = F.array_distinct(F.transform(ordered, lambda e: e["line"]))
    return F.array_join(
        F.transform(lines, lambda n: F.array_join(
            F.transform(F.filter(ordered, lambda e: e["line"] == n), lambda e: e[field]), " ")),
        "\n",
    )


def comparable_reading(a: DataFrame, b: DataFrame, by: Sequence[str] = PAGE, touch: float | None = None) -> DataFrame:
    """The observation of reader B that may be compared with each word of reader A.

    Several B words inside one A word are united when their bounds fit; otherwise the best single
    word of similar size, equal text first, then larger overlap. Left outer over ``a``. With ``touch``,
    ``touched`` says whether any B word covers, or is covered by, more than that share.
    """
    return a.join(_readings(a, b, by, touch), [*by, "token_id"], "left")


def _readings(a: DataFrame, b: DataFrame, by: Sequence[str], touch: float | None = None) -> DataFrame:
    """The observation of each word of reader A that has one; every word id once."""
    A, B = box("a_"), box("b_")
    pairs = near_join(a.select(*by, "token_id", "x", "y", "w", "h", "text_key"),
                      b.select(*by, "token_id", "line_id", "x", "y", "w", "h", "text", "text_key", "conf"), by)
    near_by = (vertical_share(A, B) > 0.6) & (share(B, A) > 0.55)
    touching = F.lit(False) if touch is None else share_either(A, B) > touch
    pairs = pairs.withColumns({"_near": near_by, "_touch": touching}).where(F.col("_near") | F.col("_touch"))
    similar = (
        (B.w >= A.w * 0.45) & (B.w <= A.w * 2.2) & (B.h >= A.h * 0.45) & (B.h <= A.h * 2.2)
    )
    # every B word is sent once; bounds and the best single word are taken from the gathered words
    word = F.struct(
        F.col("b_line_id").alias("line"), B.x.alias("x"), B.y.alias("y"), F.col("b_token_id").alias("ord"),
        F.col("b_text").alias("text"), F.col("b_text_key").alias("text_key"), B.w.alias("w"), B.h.alias("h"), F.col("b_conf").alias("conf"),
        F.when(F.col("b_text_key") == F.col("a_text_key"), 0).otherwise(1).alias("differs"), (-share(B, A)).alias("away"), similar.alias("similar"),
    )
    near = pairs.groupBy(*by, F.col("a_token_id").alias("token_id")).agg(
        F.first("a_w").alias("aw"), F.first("a_h").alias("ah"),
        F.collect_list(F.when(F.col("_near"), word)).alias("words"), F.max("_touch").alias("touched"),
    )
    near = near.where((F.size("words") > 1) | F.exists("words", lambda e: e["similar"]) | F.col("touched"))
    of = lambda value: F.transform("words", value)
    alone = F.transform(F.filter("words", lambda e: e["similar"]), lambda e: F.struct(
        e["differs"].alias("differs"), e["away"].alias("away"), e["ord"].alias("id"), *[e[c].alias(c) for c in ("text", "text_key", "conf", "x", "y", "w", "h")]))
    near = near.withColumns({
        "gx": F.array_min(of(lambda e: e["x"])), "gy": F.array_min(of(lambda e: e["y"])),
        "gr": F.array_max(of(lambda e: e["x"] + e["w"])), "gb": F.array_max(of(lambda e: e["y"] + e["h"])),
        "gconf": F.array_min(of(lambda e: F.coalesce(e["conf"], F.lit(0.0)))), "single": F.array_min(alone)})
    gw, gh = F.col("gr") - F.col("gx"), F.col("gb") - F.col("gy")
    united = (F.size("words") > 1) & (gw >= F.col("aw") * 0.5) & (gw <= F.col("aw") * 1.6) & (gh <= F.col("ah") * 1.6)
    near = near.withColumn("united", F.coalesce(united, F.lit(False)))
    united = F.col("united")
    near = near.withColumn("ordered", F.when(united, reading_order_in_lines(F.col("words"))))
    pick = lambda group, one: F.when(united, group).otherwise(F.col("single")[one])
    return near.select(
        *by, "token_id",
        F.when(united, F.transform("ordered", lambda e: e["ord"])).when(F.col("single").isNotNull(), F.array(F.col("single.id"))).alias("b_ids"),
        pick(lines_to_text(F.col("ordered")), "text").alias("b_text"),
        pick(F.array_join(F.transform("ordered", lambda e: e["text_key"]), ""), "text_key").alias("b_text_key"),
        pick(F.col("gconf"), "conf").alias("b_conf"),
        pick(F.col("gx"), "x").alias("b_x"), pick(F.col("gy"), "y").alias("b_y"),
        pick(gw, "w").alias("b_w"), pick(gh, "h").alias("b_h"), *([] if touch is None else ["touched"]),
    )


def overlapping_words(a: DataFrame, b: DataFrame, by: Sequence[str] = PAGE, over: float = 0.45) -> DataFrame:
    """Pairs of readings that cover each other by more than ``over`` in either direction."""
    pairs = near_join(a.select(*by, "token_id", "x", "y", "w", "h"),
                      b.select(*by, "token_id", "x", "y", "w", "h"), by)
    return pairs.where(share_either(box("a_"), box("b_")) > over)


def compared_words(a: DataFrame, b: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Outcome per A word: agreement, disagreement, segmentation mismatch or unmatched."""
    read = comparable_reading(a, b, by, touch=0.45)
    outcome = (
        F.when(F.col("b_text_key") == F.col("text_key"), "agreement")
        .when(F.col("b_text_key").isNotNull(), "disagreement")
        .when(F.col("touched"), "segmentation_mismatch").otherwise("unmatched")
    )
    return read.withColumn("outcome", outcome).drop("touched")


def reading_agreement(a: DataFrame, b: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Per page: how far the two readers agree."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return compared_words(a, b, by).groupBy(*by).agg(
        count("agreement").alias("agreements"), count("disagreement").alias("disagreements"),
        count("segmentation_mismatch").alias("segmentation_mismatches"), count("unmatched").alias("unmatched"),
    )


def segmentation_mismatch(a: DataFrame, b: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """A words that B covers without offering a comparable reading."""
    return compared_words(a, b, by).where(F.col("outcome") == "segmentation_mismatch").select(*a.columns)


def _piece_conflicts(pieces: DataFrame, primary: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Coarse words whose pieces overlap one another, or overlap another primary word."""
    keys = [*by, "raw_id"]
    P, Q = box("a_"), box("b_")
    among = near_join(pieces, pieces, keys).where(
        (F.col("a_token_id") < F.col("b_token_id")) & (share_either(P, Q) > 0.15)
    ).select(*keys).distinct()
    others = near_join(pieces, primary.select(*by, "token_id", "x", "y", "w", "h"), by).where(
        (F.col("b_token_id") != F.col("a_raw_id")) & (share_either(P, Q) > 0.3)
    ).select(*by, F.col("a_raw_id").alias("raw_id")).distinct()
    return among, others


def _cut_text(raw: Column, keys: Column) -> Column:
    """Cut the raw spelling where its non-blank characters complete each key in turn."""
    def part(key: Column, i: Column) -> Column:
        before = F.length(F.array_join(F.slice(keys, 1, i), ""))
        pattern = F.concat(F.lit(r"^\s*(?:\S\s*){"), before.cast("string"), F.lit(r"}((?:\S\s*){"),
                           F.length(key).cast("string"), F.lit("})"))
        return F.trim(F.call_function("regexp_extract", raw, pattern, F.lit(1)))

    return F.transform(keys, part)


def split_coarse_tokens(a: DataFrame, b: DataFrame, regional: DataFrame | None = None,
                        by: Sequence[str] = PAGE) -> DataFrame:
    """Replace a coarse word by B's boxes where B spells exactly the same complete text.

    Result: ``a``'s rows plus ``outcome`` ('kept', 'split', 'reboxed'), ``raw_token_id``,
    ``part_no``, ``source_token_ids``; replaced words keep A's spelling and get B's boxes.
    """
    cols = [*by, "token_id", "line_id", "x", "y", "w", "h", "text_key"]
    A, B = box("a_"), box("b_")
    coarse = a.where(F.col("source") == "ocr")
    inside = near_join(coarse.select(*by, "token_id", "x", "y", "w", "h", "text_key"), b.select(*cols), by)
    inside = inside.where(share(B, A) > 0.8)
    word = F.struct(F.col("b_line_id").alias("line"), B.x.alias("x"), B.y.alias("y"), F.col("b_token_id").alias("ord"),
                    B.w.alias("w"), B.h.alias("h"), F.col("b_text_key").alias("key"))
    groups = inside.groupBy(*by, F.col("a_token_id").alias("token_id")).agg(
        F.first("a_text_key").alias("raw_key"), F.first(A.area).alias("raw_area"),
        F.count(F.lit(1)).alias("n"), F.collect_list(word).alias("words"))
    groups = groups.withColumn("ordered", reading_order_in_lines(F.col("words")))
    groups = groups.withColumn("joined", F.array_join(F.transform("ordered", lambda e: e["key"]), ""))
    # read by both tests of the pieces and by what they leave: written once
    groups = cut_lineage(groups.where(F.col("joined") == F.col("raw_key")).drop("joined"))
    pieces = groups.select(*by, F.col("token_id").alias("raw_id"), F.explode("ordered").alias("p")).select(
        *by, "raw_id", F.col("p.ord").alias("token_id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"),
        F.col("p.w").alias("w"), F.col("p.h").alias("h"))
    among, others = _piece_conflicts(pieces, a, by)
    refused = cut_lineage(among.union(others).distinct().withColumnRenamed("raw_id", "token_id"))
    accepted = groups.join(refused, [*by, "token_id"], "left_anti")
    if regional is None:
        accepted = accepted.where(F.col("n") > 1)
    else:
        one = accepted.where(F.col("n") == 1).select(
            *by, "token_id", *[F.col("ordered")[0][c].alias(c) for c in ("x", "y", "w", "h")], "raw_key")
        seen = near_join(one, regional.select(*by, "x", "y", "w", "h", "text_key"), by).where(
            (F.col("a_raw_key") == F.col("b_text_key")) & (share(A, B) > 0.7) & (share(B, A) > 0.7)
        ).select(*by, F.col("a_token_id").alias("token_id")).distinct().withColumn("seen", F.lit(True))
        size = F.col("ordered")[0]["w"] * F.col("ordered")[0]["h"]
        accepted = accepted.join(seen, [*by, "token_id"], "left").where(
            (F.col("n") > 1) | (F.col("seen") & (F.col("raw_area") >= size * 2.5))).drop("seen")
    chosen = accepted.select(*by, "token_id", "n", "ordered")
    joined = a.join(chosen, [*by, "token_id"], "left")
    joined = joined.withColumn("parts", _cut_text(F.col("text"), F.transform("ordered", lambda e: e["key"])))
    exploded = joined.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n"), F.lit(1)).cast("int") - 1)))
    piece = F.get(F.col("ordered"), F.col("part_no"))
    replaced = F.col("ordered").isNotNull()
    plain = [c for c in a.columns if c not in (*by, "token_id", "x", "y", "w", "h", "text")]
    return exploded.select(
        *by,
        F.when(F.col("n") > 1, F.concat(F.col("token_id").cast("string"), F.lit("-seg-"), F.col("part_no").cast("string")))
        .otherwise(F.col("token_id").cast("string")).alias("token_id"),
        *[F.when(replaced, piece[c]).otherwise(F.col(c)).alias(c) for c in ("x", "y", "w", "h")],
        F.when(F.col("n") > 1, F.get(F.col("parts"), F.col("part_no"))).otherwise(F.col("text")).alias("text"),
        *plain,
        F.when(F.col("n") > 1, "split").when(replaced, "reboxed").otherwise("kept").alias("outcome"),
        F.col("token_id").alias("raw_token_id"), F.col("part_no").cast("bigint").alias("part_no"),
        F.transform("ordered", lambda e: e["ord"]).alias("source_token_ids"),
    )


def typical_height(tokens: DataFrame, by: Sequence[str] = PAGE, pick=lower_median, name="typical_h") -> DataFrame:
    """Median height of the words taller than 5 per page, from a histogram of heights.

    Heights repeat, so the histogram is small however many words one page holds.
    """
    counts = tokens.where(F.col("h") > 5).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))
    bins = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("bins"),
                                   F.sum("n").alias("total"))
    rank = F.floor((F.col("total") - 1) / 2) if pick is lower_median else F.floor(F.col("total") / 2)
    walked = F.aggregate(
        "bins", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("h")),
        lambda acc, e: F.struct(
            (acc["seen"] + e["n"]).alias("seen"),
            F.when(acc["h"].isNull() & (acc["seen"] + e["n"] > rank), e["h"]).otherwise(acc["h"]).alias("h")),
    )
    return bins.select(*by, walked["h"].alias(name))


def recover_coarse(a: DataFrame, local: DataFrame, b: DataFrame, page: DataFrame,
                   by: Sequence[str] = PAGE) -> DataFrame:
    """One decision per weak oversized A word: may its local re-reading replace it?"""
    heights = typical_height(a.select(*by, "h").unionByName(b.select(*by, "h")), by)
    sized = a.join(page.select(*by, "page_w", "page_h"), list(by)).join(heights, list(by), "left")
    h = F.coalesce("typical_h", F.lit(20.0))
    coarse = (F.col("h") > h * 2.4) | (
        F.col("w") > F.greatest(F.col("page_w") * 0.25, h * F.greatest(F.lit(3), F.length("text")) * 1.1))
    weak = sized.where((F.col("source") == "ocr") & (F.coalesce("conf", F.lit(100.0)) < 62) & coarse)
    # read by several tests each: written once, and the files shuffled for one go before the next
    weak = cut_lineage(weak.select(*by, "token_id", "x", "y", "w", "h", "text"))
    A, B = box("a_"), box("b_")
    readable = lambda df: valid_boxes(df, page, by)
    local_ok = readable(local).where(F.col("text").rlike(LETTER_OR_DIGIT))
    pieces = near_join(weak, local_ok.select(*by, "token_id", "x", "y", "w", "h", "text", "text_key", "conf"), by).where(
        share(B, A) > 0.8
    ).select(*by, F.col("a_token_id").alias("raw_id"), *[F.col("b_" + c).alias(c) for c in
             ("token_id", "x", "y", "w", "h", "text", "text_key", "conf")])
    pieces = cut_lineage(pieces)
    b_ok = cut_lineage(readable(b).select(*by, "token_id", "x", "y", "w", "h", "text", "text_key"))
    same_place = (F.col("a_text_key") == F.col("b_text_key")) & (share(A, B) > 0.55) & (share(B, A) > 0.55)
    keys = [*by, "raw_id"]
    witnessed = near_join(pieces, b_ok, by).where(same_place).groupBy(
        *by, F.col("a_raw_id").alias("raw_id"), F.col("a_token_id").alias("token_id")).agg(F.min("b_token_id").alias("witness"))
    checked = pieces.join(cut_lineage(witnessed), [*keys, "token_id"], "left")
    needed = F.when(F.col("text").rlike(r"\d"), 85).otherwise(70)
    per_raw = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce("conf", F.lit(0.0)) < needed).alias("low"),
        F.max(F.col("witness").isNull()).alias("unwitnessed"),
        F.array_sort(F.collect_list("token_id")).alias("piece_ids"))
    among, others = _piece_conflicts(pieces.select(*keys, "token_id", "x", "y", "w", "h"), a, by)
    expected = near_join(weak, b_ok.where(F.col("text").rlike(LETTER_OR_DIGIT)), by).where(share(B, A) > 0.8).select(
        *by, F.col("a_token_id").alias("raw_id"), *[F.col("b_" + c).alias(c) for c in ("token_id", "x", "y", "w", "h", "text_key")])
    expected = cut_lineage(expected)
    met = near_join(expected, pieces.select(*keys, "x", "y", "w", "h", "text_key"), keys).where(same_place).select(
        *keys, F.col("a_token_id").alias("token_id")).distinct()
    incomplete = expected.join(met, [*keys, "token_id"], "left_anti").select(*keys).distinct()
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    judged = (
        weak.withColumnRenamed("token_id", "raw_id").join(per_raw, keys, "left")
        .join(flag(among, "overlapping"), keys, "left").join(flag(others, "other"), keys, "left")
        .join(flag(incomplete, "incomplete"), keys, "left")
    )
    reason = (
        F.when(F.col("n").isNull(), "NO_COMPLETE_LOCAL_READING")
        .when(F.col("low"), "LOW_LOCAL_CONFIDENCE").when(F.col("overlapping"), "OVERLAPPING_LOCAL_WORDS")
        .when(F.col("unwitnessed"), "INDEPENDENT_TEXT_OR_GEOMETRY_DISAGREEMENT")
        .when(F.col("incomplete"), "INCOMPLETE_LOCAL_COVERAGE").when(F.col("other"), "OTHER_PRIMARY_TOKEN_CONFLICT")
        .otherwise("COARSE_TOKEN_CORROBORATED_BY_TWO_READERS")
    )
    return judged.select(
        *by, F.col("raw_id").alias("token_id"), reason.alias("reason"),
        F.when(reason == "COARSE_TOKEN_CORROBORATED_BY_TWO_READERS", "recovered").otherwise("retained").alias("outcome"),
        F.coalesce(F.col("n"), F.lit(0)).alias("local_words"), "piece_ids")


def recover_missing(a: DataFrame, local: DataFrame, b: DataFrame, region: DataFrame, page: DataFrame,
                    by: Sequence[str] = PAGE) -> DataFrame:
    """Words read at the same place by the local reading and by B, and absent in A."""
    A, B = box("a_"), box("b_")
    needed = F.when(F.col("text").rlike(r"\d"), 85).otherwise(70)
    strong = valid_boxes(local, page, by).where(
        F.col("text").rlike(LETTER_OR_DIGIT) & (F.coalesce("conf", F.lit(0.0)) >= needed))
    # read by the regions, by A's words and by the tops of the lines: written once
    strong = cut_lineage(strong.select(*by, "token_id", "line_id", "x", "y", "w", "h", "text", "text_key", "conf"))
    in_region = near_join(strong, region.select(*by, "x", "y", "w", "h"), by).where(share(A, B) > 0.8)
    held = near_join(strong, a.select(*by, "x", "y", "w", "h"), by).where(share_either(A, B) > 0.15)
    free = without_partner(strong, held, by, ["token_id"]).join(
        in_region.select(*by, F.col("a_token_id").alias("token_id")).distinct(), [*by, "token_id"], "left_semi")
    b_ok = valid_boxes(b, page, by).select(*by, "token_id", "x", "y", "w", "h", "text_key")
    agreed = near_join(free, b_ok, by).where(
        (F.col("a_text_key") == F.col("b_text_key")) & (share(A, B) > 0.55) & (share(B, A) > 0.55))
    source = agreed.groupBy(*by, F.col("a_token_id").alias("token_id")).agg(F.min("b_token_id").alias("b_token_id"))
    tops = strong.groupBy(*by, "line_id").agg(F.min("y").alias("line_top"))
    found = free.join(source, [*by, "token_id"]).join(tops, [*by, "line_id"])
    # an inserted word also blocks the words that come after it in reading order
    return greedy_keep(
        found, by, "token_id", [F.col("line_top"), F.col("line_id"), F.col("x"), F.col("token_id")],
        lambda k, c: share_either(box_of(k), box_of(c)) > 0.15, box(),
    ).drop("line_top")


def critical_guard(decision: DataFrame, local: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """A change that touches digits stands only on a strong local reading of the same text.

    ``decision``: one row per A word with its box, ``text``, ``selected_text``, ``selected_key``, ``changed``.
    """
    near = comparable_reading(
        decision.where("changed").select(*by, "token_id", "x", "y", "w", "h", "text_key"), local, by
    ).select(*by, "token_id", F.col("b_text_key").alias("local_key"), F.col("b_conf").alias("local_conf"))
    joined = decision.join(near, [*by, "token_id"], "left")
    critical = F.col("changed") & F.concat("text", "selected_text").rlike(r"\d")
    backed = F.coalesce((F.col("local_conf") >= 85) & (F.col("local_key") == F.col("selected_key")), F.lit(False))
    stopped = critical & ~backed
    return joined.select(
        *[F.when(stopped, F.col("text")).otherwise(F.col("selected_text")).alias("selected_text") if c == "selected_text"
          else F.when(stopped, F.lit(False)).otherwise(F.col("changed")).alias("changed") if c == "changed"
          else F.when(stopped, "CRITICAL_VALUE_NEEDS_PRIMARY_LOCAL_AGREEMENT").otherwise(F.col("reason")).alias("reason")
          if c == "reason" else F.col(c) for c in decision.columns])


def vote_reading(a: DataFrame, b: DataFrame, b_region: DataFrame, local: DataFrame | None = None,
                 by: Sequence[str] = PAGE) -> DataFrame:
    """Choose the text of each A word: it changes only if B and B's regional reading agree
    with each other against it and A is unsure (<80). Boxes stay A's."""
    # each reading is compared by itself: the files shuffled for one go before the other
    full = cut_lineage(_readings(a, b, by).select(*by, "token_id", F.col("b_text").alias("full_text"), F.col("b_text_key").alias("full_key")))
    first = a.join(full, [*by, "token_id"], "left")
    second = cut_lineage(comparable_reading(a.select(*by, "token_id", "x", "y", "w", "h", "text_key"), b_region, by).select(
        *by, "token_id", F.col("b_text_key").alias("region_key")))
    changed = F.coalesce(
        (F.col("full_key") == F.col("region_key")) & (F.col("full_key") != F.col("text_key"))
        & (F.coalesce("conf", F.lit(0.0)) < 80), F.lit(False))
    voted = first.join(second, [*by, "token_id"], "left").withColumn("changed", changed).select(
        *a.columns,
        F.when(F.col("changed"), F.col("full_text")).otherwise(F.col("text")).alias("selected_text"),
        F.when(F.col("changed"), F.col("full_key")).otherwise(F.col("text_key")).alias("selected_key"),
        F.when(F.col("changed"), "TWO_OBSERVATIONS_AGREE").otherwise("PRIMARY_KEPT").alias("reason"), "changed")
    return voted if local is None else critical_guard(cut_lineage(voted), local, by)


def reader_state(page: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Execution, availability and reason of the second reader, from per-page counts and flags.

    ``page``: ``native``, ``enabled``, ``custom_reader``, ``secondary_words`` (null: not run), ``warnings_n``.
    """
    ran = F.col("enabled") & ~F.col("custom_reader") & ~F.col("native")
    failed = ran & (F.coalesce("secondary_words", F.lit(0)) == 0) & (F.col("warnings_n") > 0)
    empty = ran & (F.coalesce("secondary_words", F.lit(0)) == 0) & (F.col("warnings_n") == 0)
    return page.select(
        *by,
        F.when(~F.col("enabled"), "disabled").when(~ran, "not-needed").when(failed, "fallback-primary")
        .otherwise("completed").alias("execution"),
        F.when(~F.col("enabled") | F.col("custom_reader"), "not-configured").when(~ran, "provided-unverified")
        .when(failed, "unavailable").otherwise("available").alias("availability"),
        F.when(~F.col("enabled"), "INDEPENDENT_READING_DISABLED").when(F.col("custom_reader"), "CUSTOM_OCR_RUNNER")
        .when(F.col("native"), "NATIVE_PDF_TEXT").when(failed, "RECOGNIZER_B_UNAVAILABLE")
        .when(empty, "RECOGNIZER_B_EMPTY").otherwise("DUAL_READING_COMPLETED").alias("reason"),
        F.when(ran, F.coalesce("secondary_words", F.lit(0))).alias("returned_words"))


def merge_native_and_ocr(native: DataFrame, ocr: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Native words, and the OCR words that no native word covers by more than 0.55."""
    covered = near_join(ocr, native.select(*by, "x", "y", "w", "h"), by).where(share(box("a_"), box("b_")) > 0.55)
    return native.unionByName(without_partner(ocr, covered, by, ["token_id"]))


def merge_word_streams(words: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Union of readers by falling confidence; near-identical observations are dropped.

    ``words`` carries a page-unique ``word_id`` that also fixes the order among equal confidences.
    """
    tidy = F.trim(F.regexp_replace("text", r"\s+", " "))
    usable = words.withColumn("text", tidy).where((F.col("text") != "") & (F.col("w") > 0) & (F.col("h") > 0))
    usable = usable.withColumn("_low", F.lower("text"))

    def duplicate(k: Column, c: Column) -> Column:
        a, b = box_of(k), box_of(c)
        scale = F.greatest(F.lit(4.0), F.least(a.h, b.h) * 0.55)
        near = (k["_low"] == c["_low"]) & (F.abs(a.cx - b.cx) <= F.greatest(scale, F.least(a.w, b.w) * 0.22)) & (
            F.abs(a.cy - b.cy) <= scale)
        w = F.greatest(F.lit(0.0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
        h = F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))
        inter = w * h
        # most pairs stand on different lines: their heights are compared first
        apart = (F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y) <= 0) | (F.least(a.right, b.right) - F.greatest(a.x, b.x) <= 0)
        return near | (~apart & (inter >= 0.68 * (a.area + b.area - inter)))

    slack = F.greatest(F.lit(4.0), F.col("h") * 0.55, F.col("w") * 0.22)
    return greedy_keep(usable, by, "word_id", [-F.coalesce("conf", F.lit(0.0)), F.col("word_id")],
                       duplicate, box().grown(slack, slack, slack, slack)).drop("_low")
