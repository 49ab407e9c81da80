"""Scoring operators: texts and items in, a long table of scores out; lexicons, glossaries, judge work lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normscape.functions import text as T
from normscape.functions import vectors as V
from normscape.sources.shared import settled, small


def score_count_occurrences(texts: DataFrame, phrases: list[str], text_col: str = "text", case_sensitive: bool = False) -> DataFrame:
    """(traj_idx, arm, struct_idx, score): occurrences / words of each phrase; 0 without words. One scan, no join."""
    counted = texts.select("traj_idx", "arm", F.col(text_col).alias("t"), T.word_count(F.col(text_col)).alias("n"))  # n once a text
    scores = [F.struct(F.lit(i).alias("struct_idx"), F.when(F.col("n") > 0, T.count_occurrences(F.col("t"), p, case_sensitive) / F.col("n")).otherwise(0.0).alias("score")) for i, p in enumerate(phrases)]
    return counted.select("traj_idx", "arm", F.inline(F.array(*scores)))


def score_similarity(vectors: DataFrame, references: DataFrame) -> DataFrame:
    """(vec_id, ref_id, score): (cos + 1) / 2 clipped; a zero norm gives 0.5. references is a set of items, a row each."""
    refs = references.select("ref_id", F.col("embedding").cast("array<double>").alias("r"))
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    dot = V.total(F.zip_with("v", "r", lambda a, b: a * b))
    norms = V.norm(F.col("v")) * V.norm(F.col("r"))
    cos = F.when(norms == 0, 0.0).otherwise(dot / F.when(norms != 0, norms))
    return x.crossJoin(small(refs)).select("vec_id", "ref_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2)).alias("score"))


def build_lexicon(marked: DataFrame, unmarked: DataFrame, prior: DataFrame | None = None, min_count: int = 5, text_col: str = "text") -> DataFrame:
    """(word, z): log-odds with a prior of words of marked against unmarked texts.

    Counts have the prior (1 where it has no entry) added; words below min_count on either side go.
    """
    side = lambda df, m: df.select(F.explode(T.simple_tokens(F.col(text_col))).alias("word"), F.lit(m).alias("m"))
    counts = side(marked, 1).unionByName(side(unmarked, 0)).groupBy("word").agg(F.sum("m").alias("g"), F.sum(1 - F.col("m")).alias("u"))
    if prior is None:
        counts, mass = counts.withColumn("p", F.lit(1.0)), F.lit(0.0)
    else:
        counts = counts.join(prior.select("word", F.col("count").cast("double").alias("p")), "word", "left").fillna(1.0, ["p"])
        mass = F.col("np")
    sums = counts.agg(F.sum("g").alias("ng"), F.sum("u").alias("nu"))
    if prior is not None:
        sums = sums.crossJoin(F.broadcast(prior.agg(F.sum("count").cast("double").alias("np"))))
    df = counts.crossJoin(F.broadcast(sums))  # one row of totals
    tg, tu = F.col("g") + F.col("p"), F.col("u") + F.col("p")
    odds = F.ln(tg / (F.col("ng") + mass - tg + 1)) - F.ln(tu / (F.col("nu") + mass - tu + 1))
    return df.where((tg >= min_count) & (tu >= min_count)).select("word", (odds / F.sqrt(1 / tg + 1 / tu)).alias("z"))


def score_lexicon(texts: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """(traj_idx, score, words_scored, total_words): positive share of the z mass, per token occurrence."""
    words = texts.select("traj_idx", F.explode_outer(T.simple_tokens(F.col(text_col))).alias("word")).groupBy("traj_idx", "word").agg(F.count("word").alias("c"))
    hit = words.join(lexicon, "word", "left")
    z, c = F.coalesce("z", F.lit(0.0)), F.col("c")
    return hit.groupBy("traj_idx").agg((F.sum(F.greatest(z, F.lit(0.0)) * c) / (F.sum(F.abs(z) * c) + 1e-10)).alias("score"), F.sum(F.when(F.col("z").isNotNull(), c).otherwise(0)).alias("words_scored"), F.sum(c).alias("total_words"))


def top_lexicon_words(lexicon: DataFrame, k: int = 10) -> DataFrame:
    """(side, word, z): the k highest and lowest words, ties by word; two bounded top-k sorts."""
    top = lexicon.orderBy(F.desc("z"), "word").limit(k).withColumn("side", F.lit("high"))
    return top.unionByName(lexicon.orderBy("z", "word").limit(k).withColumn("side", F.lit("low"))).select("side", "word", "z")


def top_words_by_text(texts: DataFrame, lexicon: DataFrame, k: int = 5, text_col: str = "text") -> DataFrame:
    """(traj_idx, side, place, word, z): the k highest and lowest scored words of each text, a word as often as it occurs.

    high: above 0, low: below 0; ties by word. A text's words are its own group, of the size of a text; the lexicon is
    broadcast, so that a very common word is not one task's.
    """
    words = texts.select("traj_idx", F.explode(T.simple_tokens(F.col(text_col))).alias("word")).join(small(settled(lexicon.where("z <> 0")), 300_000), "word")
    rows = words.withColumn("side", F.when(F.col("z") > 0, "high").otherwise("low"))
    w = Window.partitionBy("traj_idx", "side").orderBy(F.desc(F.abs("z")), "word")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("traj_idx", "side", "place", "word", "z")


def score_bundles(texts: DataFrame, bundles: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(traj_idx, struct_idx, scores): any function of single items over bundles of items.

    bundles (struct_idx, items array); score: (texts, items (struct_idx, item_idx, item)) to rows (traj_idx, struct_idx,
    item_idx, score). A bundle's scores come back in the order of its items, null where there is none.
    """
    items = bundles.select("struct_idx", F.posexplode("items").alias("item_idx", "item"))
    found = score(texts, items).select("traj_idx", "struct_idx", "item_idx", "score")
    own = found.groupBy("traj_idx", "struct_idx").agg(F.map_from_entries(F.collect_list(F.struct("item_idx", "score"))).alias("__by"))
    sized = own.join(small(bundles.select("struct_idx", F.size("items").alias("__n"))), "struct_idx")
    at = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.try_element_at("__by", i))
    return sized.select("traj_idx", "struct_idx", at.alias("scores"))


def match_glossary(texts: DataFrame, glossary: DataFrame, text_col: str = "text") -> DataFrame:
    """(traj_idx, surface_form): one row for each text that holds a form at word boundaries, whatever the case.

    Texts meet forms by an equi-join on the form's first word, which settles forms of one word; texts are joined
    again, and searched, only for longer forms whose first word they hold.
    """
    form, word = F.lower("surface_form"), r"[\p{L}\p{N}_]+"
    forms = glossary.select("surface_form", form.alias("form"), F.regexp_extract(form, word, 0).alias("w")).distinct()
    words = texts.select("traj_idx", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(word), F.lit(0)))).alias("w"))
    hit = words.join(forms, "w")
    short = hit.where("form = w").select("traj_idx", "surface_form")
    long = hit.where("form <> w").join(texts.select("traj_idx", F.lower(text_col).alias("t")), "traj_idx")
    long = long.where("contains(t, form)").where(F.expr(r"regexp_like(t, concat('\\b\\Q', form, '\\E\\b'))"))
    return short.unionByName(long.select("traj_idx", "surface_form"))


def aggregate_probs(p: Column, how: str = "noisy_or") -> Column:
    """Aggregate of probabilities: noisy_or, max or mean; nothing gives 0."""
    if how == "noisy_or":
        out = 1 - F.product(1 - p)
    elif how in ("max", "mean"):
        out = {"max": F.max, "mean": F.avg}[how](p)
    else:
        raise ValueError(f"unknown aggregation {how!r}")
    return F.coalesce(out, F.lit(0.0))


def score_whistles(texts: DataFrame, matches: DataFrame, how: str = "noisy_or") -> DataFrame:
    """(traj_idx, score, raw) from matches (traj_idx, surface_form, p): an unreadable p is 0.5, no match 0."""
    p = F.coalesce("p", F.lit(0.5))
    agg = matches.groupBy("traj_idx").agg(aggregate_probs(p, how).alias("score"), F.concat_ws("; ", F.sort_array(F.collect_list(F.concat(F.col("surface_form"), F.lit("="), F.format_number(p, 2))))).alias("raw"))
    return texts.select("traj_idx").join(agg, "traj_idx", "left").select("traj_idx", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("raw", F.lit("no_matches")).alias("raw"))


def score_hypotheses(entailment: DataFrame, how: str = "mean") -> DataFrame:
    """(traj_idx, score, top): one score over all hypotheses; blanks and `_` are left out; the three likeliest."""
    kept = entailment.where("trim(hypothesis) NOT IN ('', '_')")
    top = F.slice(F.sort_array(F.collect_list(F.struct("p", "hypothesis")), asc=False), 1, 3)
    return kept.groupBy("traj_idx").agg(aggregate_probs(F.col("p"), how).alias("score"), F.concat_ws("; ", F.transform(top, lambda x: x["hypothesis"])).alias("top"))


def judge_worklist(texts: DataFrame, items: DataFrame, done: DataFrame, template: str = "Text: %s\nQuestion: %s\nANSWER:") -> DataFrame:
    """(traj_idx, struct_idx, prompt): what is still to be asked; items are a configuration's questions."""
    todo = texts.select("traj_idx", "text").crossJoin(small(items.select("struct_idx", "question")))
    return todo.join(done.select("traj_idx", "struct_idx"), ["traj_idx", "struct_idx"], "left_anti").select("traj_idx", "struct_idx", F.format_string(template, "text", "question").alias("prompt"))


def parse_failure_rate(responses: DataFrame, parsed: Column) -> DataFrame:
    return responses.groupBy("judge", "question").agg(F.avg(parsed.isNull().cast("double")).alias("failure_rate"), F.count("*").alias("n"))
