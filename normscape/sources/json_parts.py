"""Large JSON files in parallel: the elements of an array inside one document, a row each.

A reader of whole documents puts a file into one task. Here it is read as text that ends at every closing brace, so that
its splits go to many tasks. Whether a fragment begins inside a string, and how deep, follows from running sums over all
fragments before it; elements of the array end where the depth returns to the array's. The sums are over rows without the
text, which moves twice: to the number of its element, and to the rest of it. Only fragments that touch what is above the
array (its beginning and end, other values there) are walked one after another, to find where the array is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normscape.operators.ranking import running
from normscape.sources.shared import settled, small

_ORDER = ("file", "block", "row")


def _outside(text: Column) -> Column:
    """The brackets of a text without escapes that begins outside of strings; an open string reaches to its end."""
    return F.regexp_replace(F.regexp_replace(text, r'"[^"]*("|$)', ""), r"[^\[\]{}]", "")


def _depths(plain: Column, inside: bool, odd: Column) -> Column:
    """(change, low) of the depth over a fragment that begins inside or outside of a string, its closing brace included."""
    closes = F.when(odd == int(inside), "}").otherwise("")
    marks = F.concat(_outside(F.concat(F.lit('"'), plain) if inside else plain), closes)
    steps = F.transform(F.filter(F.split(marks, ""), lambda m: m != ""), lambda m: F.when(m.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("change"), F.lit(0).alias("low"))
    return F.aggregate(steps, start, lambda s, x: F.struct((s["change"] + x).alias("change"), F.least(s["low"], s["change"] + x).alias("low")))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, text): the text before each closing brace; row tells all of them apart."""
    raw = spark.read.option("lineSep", "}").text(path)
    return settled(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text")))


def _fragments(texts: DataFrame) -> DataFrame:
    """(file, block, row, inside, depth, after, least) of _texts(), whose text no running sum carries along.

    inside: it begins in a string; depth: of containers at its beginning, after: behind its closing brace, least: the
    smallest on the way.
    """
    plain = F.regexp_replace("text", r"(?s)\\.", "")  # no fragment ends in the middle of an escape: \} is none
    rows = texts.select(*_ORDER, plain.alias("__plain")).withColumn("__odd", F.length(F.regexp_replace("__plain", '[^"]', "")) % 2)
    rows = rows.select(*_ORDER, "__odd", *[_depths(F.col("__plain"), i, F.col("__odd")).alias(n) for n, i in (("__out", False), ("__in", True))])
    order = [F.col("block"), F.col("row")]
    rows = running(rows, ["file"], order, F.col("__odd"), "__quotes")
    rows = rows.withColumn("inside", (F.col("__quotes") - F.col("__odd")) % 2 == 1)
    own = F.when(F.col("inside"), F.col("__in")).otherwise(F.col("__out"))
    rows = rows.select(*_ORDER, "inside", own["change"].alias("__change"), own["low"].alias("__low"))
    rows = running(rows, ["file"], order, F.col("__change"), "after").withColumn("depth", F.col("after") - F.col("__change"))
    return rows.select(*_ORDER, "inside", "depth", "after", (F.col("depth") + F.col("__low")).alias("least"))


def _places(wanted: list[tuple[str, ...]]):
    """A walk over a file's shallow fragments: (file, path, block, row, begin, end, kind) of the values at the wanted paths.

    begin and end: offsets in the text of the fragment named, null where the value begins or ends elsewhere; kind: the
    bracket that it begins with.
    """
    deepest = max(map(len, wanted))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values(["block", "row"]), []
        keys: list[str | None] = []  # of the open containers, the key that the next value belongs to
        string, literal, open_ = None, None, []  # open_: (depth, path) of wanted values that are open
        for block, row, text, inside, depth in zip(pdf["block"], pdf["row"], pdf["text"], pdf["inside"], pdf["depth"]):
            del keys[depth:]
            keys += [None] * (depth - len(keys))
            string = [] if inside else None
            at, n = 0, len(text)
            while at <= n:
                c = text[at] if at < n else "}"
                if string is not None:
                    if at == n:
                        break
                    if c == "\\":
                        string.append(text[at : at + 2])
                        at += 1
                    elif c == '"':
                        literal, string = "".join(string), None
                    else:
                        string.append(c)
                elif c == '"':
                    string = []
                elif c == ":" and keys and len(keys) <= deepest:
                    keys[-1] = literal
                elif c in "[{":
                    if (path := tuple(keys)) in wanted and None not in path:
                        open_.append((len(keys), path))
                        out.append(("/".join(path), block, row, at + 1, None, c))
                    keys.append(None)
                elif c in "]}":
                    if keys:
                        keys.pop()
                    if open_ and open_[-1][0] == len(keys):
                        out.append(("/".join(open_.pop()[1]), block, row, None, at, None))
                at += 1
        return pd.DataFrame([(pdf["file"].iloc[0], *x) for x in out], columns=["file", "path", "block", "row", "begin", "end", "kind"])

    return walk


def json_values(spark: SparkSession, path: str, *wanted: tuple[str, ...]) -> tuple[DataFrame, ...]:
    """For each wanted path of keys, a table (file, nth, value): the elements of the array there, as JSON text.

    Elements that are no objects are left out; if the value is itself an object it is the one row, put together whole. Files without such a
    value have no row. Of a key that comes twice in one object the whole stretch counts. path: one or more files.
    """
    texts = _texts(spark, path)
    fragments = settled(_fragments(texts))
    shallow = fragments.where(F.col("least") <= max(map(len, wanted))).select("row", "inside", "depth")
    shallow = texts.join(small(shallow, rows=100_000), "row").select(*_ORDER, "text", "inside", "depth")
    found = settled(shallow.groupBy("file").applyInPandas(_places(list(wanted)), "file string, path string, block long, row long, begin int, end int, kind string"))
    out = []
    for keys in wanted:
        own = found.where(F.col("path") == "/".join(keys))
        opens, closes = F.when(F.col("begin").isNotNull(), F.struct("block", "row", "begin", "kind")), F.when(F.col("end").isNotNull(), F.struct("block", "row", "end"))
        ends = own.groupBy("file").agg(F.min(opens).alias("begin"), F.max(closes).alias("end"))
        rows = fragments.join(F.broadcast(ends.withColumnRenamed("begin", "__from").withColumnRenamed("end", "__to")), "file")  # a row a file
        here = F.struct("block", "row")
        first, last = F.struct("__from.block", "__from.row"), F.struct("__to.block", "__to.row")
        rows = rows.where((here >= first) & (here <= last))
        begin, end = F.when(here == first, F.col("__from.begin")).otherwise(0), F.when(here == last, F.col("__to.end"))
        rows = rows.select(*_ORDER, begin.alias("__begin"), end.alias("__end"), (F.col("__from.kind") == "{").alias("__object"), ((F.col("after") == len(keys) + 1) & (here < last) & (F.col("__from.kind") == "[")).cast("long").alias("__ends"))
        rows = running(rows, ["file"], [F.col("block"), F.col("row")], F.col("__ends"), "__upto").withColumn("nth", F.col("__upto") - F.col("__ends"))
        rows = texts.select("row", "text").join(small(rows.drop("__upto"), rows=100_000), "row")
        text = F.substring("text", F.col("__begin") + 1, F.coalesce("__end", F.char_length("text")) - F.col("__begin"))
        parts = F.array_sort(F.collect_list(F.struct("block", "row", text.alias("text"))))
        text = F.array_join(F.transform(parts, lambda x: x["text"]), "}")
        whole = rows.groupBy("file", "nth").agg(text.alias("value"), F.max("__ends").alias("__closed"), F.max("__object").alias("__object"))
        element = F.when(F.col("__object"), F.concat(F.lit("{"), "value", F.lit("}"))).otherwise(F.concat(F.regexp_extract("value", r"(?s)^[^{]*(\{.*)$", 1), F.lit("}")))
        out.append(whole.where("__closed = 1 OR __object").select("file", "nth", element.alias("value")).where("value <> '}'"))
    return tuple(out)
