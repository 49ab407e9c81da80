"""Text selection, counting and judge-answer parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normscape.functions.vectors import let

#: End markers of common chat formats: fixed values.
EOS_MARKERS = ("<|im_end|>", "<|endoftext|>", "</s>", "<|eot_id|>")


def continuation(prefill: Column, generated: Column) -> Column:
    return F.concat(F.coalesce(prefill, F.lit("")), generated)


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def strip_thinking_response(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, "</think>"), -1))


def strip_eos(text: Column, markers: tuple = EOS_MARKERS) -> Column:
    """Without white space at its end and the one marker there, if there is one, with the white space before it."""
    quoted = "|".join(rf"\Q{m}\E" for m in markers)
    return F.regexp_replace(text, rf"\s*(?:(?:{quoted})\s*)?\z" if markers else r"\s+\z", "")


def text_after(text: Column, offset: Column) -> Column:
    return F.when(offset.isNull(), strip_thinking(text)).otherwise(F.substring(strip_thinking(text), offset + 1, F.char_length(text)))


def select_text(selection: str, prefill: Column, generated: Column, offsets: Column | None = None, prompt: Column | None = None) -> Column:
    """The part of a trajectory that is scored; offsets: a map from arm kind to characters of the continuation."""
    whole = continuation(prefill, generated)
    if selection == "WholeTrajectory":
        return F.concat(F.coalesce(prompt, F.lit("")), whole)
    if selection == "WholeContinuation":
        return whole
    if selection == "NonThinkingContinuation":
        return strip_thinking(whole)
    kind = {"AfterTrunk": "trunk", "AfterBranch": "branch", "AfterTwig": "twig"}[selection]
    return text_after(whole, offsets[kind])


def simple_tokens(text: Column) -> Column:
    """Words of a-z alone; a word that touches other letters, digits or _ is none."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: x.rlike("^[a-z]+$"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def count_occurrences(text: Column, phrase: str, case_sensitive: bool = False) -> Column:
    """Non-overlapping; single words at word boundaries, phrases with a blank anywhere."""
    quoted = "\\Q" + phrase + "\\E"
    pattern = quoted if " " in phrase else rf"\b{quoted}\b"
    return F.regexp_count(text, F.lit(("" if case_sensitive else "(?i)") + pattern))


#: Words whose ends are added up in one array, which is copied for each: so long texts cost little more a word.
_CHUNK = 512


def word_ends(text: Column) -> Column:
    """Character offset of the end of each word."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0)), F.char_length)
    last = lambda a: F.element_at(a, -1)
    added = lambda begin, xs: F.slice(F.aggregate(xs, F.array(begin), lambda a, x: F.array_append(a, last(a) + x)), 2, F.size(xs))

    def ends(own: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(own), F.lit(_CHUNK)), lambda s: F.slice(own, s, _CHUNK))
        sums = lambda cs: F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x))
        before = lambda cs: F.concat(F.array(F.lit(0)), added(F.lit(0), F.slice(sums(cs), 1, F.size(cs) - 1)))
        return let(chunks, lambda cs: F.flatten(F.zip_with(before(cs), cs, lambda b, c: added(b, c))))

    return let(lengths, lambda own: F.when(F.size(own) > 0, ends(own)).when(own.isNotNull(), F.array().cast("array<int>")))


def prefixes_at_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each word prefix: (.., position, prefix, label)."""
    ends = df.select("*", F.posexplode(word_ends(F.col(text_col))).alias("position", "__end"))
    return ends.withColumn("prefix", F.substring(text_col, F.lit(1), F.col("__end"))).withColumn("label", F.regexp_extract("prefix", r"(\S+)\s*$", 1)).drop("__end")


def prefixes_at_steps(df: DataFrame, text_col: str = "text", tokens_col: str = "n_tokens", step: int = 8) -> DataFrame:
    """Prefixes in proportion k / n at k = step, 2 step, ... and always n; blank prefixes are left out."""
    n = F.col(tokens_col)
    marks = F.when(n >= step, F.sequence(F.lit(step), n, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = df.where(n > 0).select("*", F.explode(F.array_union(marks, F.array(n))).alias("k"))
    return rows.withColumn("prefix", F.substring(text_col, F.lit(1), F.floor(F.char_length(text_col).cast("long") * F.col("k") / n).cast("int"))).where(F.trim("prefix") != "")


def is_finished(text: Column, markers: tuple = EOS_MARKERS) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def _got(text: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, group)
    return F.when(x != "", x)


def _yes_no(x: Column) -> Column:
    u = F.upper(x)
    return F.when(u.isin("1", "YES", "TRUE", "Y"), 1).when(u.isin("0", "NO", "FALSE", "N"), 0)


def parse_binary(raw: Column) -> Column:
    """0 or 1 of a judge's answer, null if there is none: the last stated answer, then weaker forms in order."""

    def forms(t: Column) -> Column:
        yes = F.when(t.rlike(r"(?i)\byes\b"), 1).when(t.rlike(r"(?i)\bno\b"), 0)
        digits = [r"(?is)^.*ANSWER\s*[:\-]\s*([01])", r"(?is)^.*ANSWER\s*[:\-]\s*(YES|NO)\b", r"^\s*([01])\s*$", r"(?i)(?:answer|response|judgment|result)[:\s]*([01])", r"([01])\s*$", r"\b([01])\b"]
        found = [_yes_no(_got(t, p)) for p in digits]
        return F.coalesce(*found[:4], yes, *found[4:])

    return let(strip_thinking_response(raw), forms)


def parse_graded(raw: Column, prefill: str = "", fallback: bool = True) -> Column:
    """A score in [0, 1]; failing that the first number if it is at most 1. A bare fraction (.5) counts as one."""
    pattern = r"\b(0(?:\.\d+)?|1(?:\.0+)?|\.\d+)\b|(?<!\S)(\.\d+)\b"

    def forms(t: Column) -> Column:
        exact = F.coalesce(_got(t, pattern, 1), _got(t, pattern, 2)).try_cast("double")
        if not fallback:
            return exact
        return F.coalesce(exact, let(_got(t, r"(\d+\.?\d*)").try_cast("double"), lambda x: F.when(x <= 1, x)))

    return let(strip_thinking_response(F.concat(F.lit(prefill), raw)), forms)


def _number(x: Column) -> Column:
    """A text that is a percentage, a fraction or a number and nothing else; above 1 to 10 in tenths, beyond that 1."""
    percent = _got(x, r"^\s*(\d+(?:\.\d+)?)\s*%\s*$").try_cast("double") / 100
    ratio = [_got(x, r"^\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*$", i).try_cast("double") for i in (1, 2)]
    plain = let(_got(x, r"^\s*(\d+\.?\d*|\.\d+)\s*$").try_cast("double"), lambda v: F.when(v <= 1, v).when(v <= 10, v / 10).when(v > 10, 1.0))
    return F.coalesce(percent, F.when(ratio[1] > 0, F.least(F.lit(1.0), ratio[0] / ratio[1])), plain)


def parse_judge_score(raw: Column) -> Column:
    """A score of a free answer: the whole of it, what a tag or else a label marks, or the last word of its last line.

    Numbers within reasoning do not count; null if nothing stands where an answer would.
    """
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1")
    tag, label, number = r"(?is)<answer>(.*?)</answer>", r"(?i)(?:ANSWER|SCORE|RATING):\s*([^\n]+)", r"\d+\.?\d*|\.\d+"
    word = r"(\S+)\s*$"

    def marked(x: Column) -> Column:
        return F.coalesce(_yes_no(x).cast("double"), _number(x), _number(_got(x, f"({number})")))

    def last_line(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_extract(line, word, 1), "^[.,!?:;\"']+|[.,!?:;\"']+$", "")
        late = F.when(line.rlike(r"[.!?01]$"), _number(_got(line, rf"[:\s]({number})\s*[.!?]?$")))
        return F.coalesce(let(bare, lambda x: F.coalesce(_number(x), _yes_no(x).cast("double"))), late)

    def answer(t: Column) -> Column:
        inside = F.when(t.rlike(tag), F.regexp_extract(t, tag, 1)).when(t.rlike(label), F.regexp_extract(t, label, 1))
        inside = let(F.regexp_replace(plain(inside), r"^\s+|\s+$", ""), lambda x: F.when(x.isNull(), let(F.regexp_extract(t, r"([^\n]*\S)\s*$", 1), last_line)).otherwise(marked(x)))
        return F.coalesce(_number(t), inside)

    return let(plain(F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")), answer)
