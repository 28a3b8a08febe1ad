"""Host-range expressions as jobs: expand, collapse, and per-node task lists.

An expression such as ``n[9-11],d[01-02]`` is a comma list of parts; a part is
text with bracketed number ranges, and several brackets multiply out. A bad
expression yields one row with ``error`` set and no host. Names and nodes are made
one per row from their number in the part; no row holds a list of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.functions.names import natural_key
from iolens.sources.shared import kept

MAX_SIZE = 100000  # fixed value: the usual largest range, expanded part, or repetition
_COUNTABLE = 10**15  # more names than that are not numbered
_RUN = 4096  # numbers that are made in one row
_TASKS_A_CORE = 4  # tasks that expressions are dealt over

# Messages of the error column.
NESTED = "nested brackets"
UNBALANCED = "unbalanced brackets"
BAD_RANGE = "bad range"
BACKWARDS = "start > stop"
LONG_RANGE = "range too large"
LARGE = "results too large"
BAD_TASKS = "bad task list syntax"
LONG_TASKS = "task list repetitions too large"
FORBIDDEN = "forbidden character"


def _bracket_error(expr: Column) -> Column:
    """What is left of the brackets after leading well-formed pairs tells the error."""
    rest = F.regexp_replace(F.regexp_replace(expr, r"[^\[\]]", ""), r"^(\[\])+", "")
    return F.when(rest.startswith("[["), NESTED).when(rest != "", UNBALANCED)


def _numbered(df: DataFrame, size: Column, name: str) -> DataFrame:
    """One row per number from 0 to ``size - 1``; runs of numbers first, then those of a run."""
    last = size - 1
    runs = df.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / _RUN))))
    end = F.least(last, F.col("__run") * _RUN + (_RUN - 1))
    return runs.withColumn(name, F.explode(F.sequence(F.col("__run") * _RUN, end))).drop("__run")


def _too_large(size: Column, max_size: int | None) -> Column:
    return size > (_COUNTABLE if max_size is None else max_size)


def _ranges(inner: Column, max_size: int | None) -> Column:
    """Numbers and low-high ranges of a bracket: error, bounds, width and size.

    Each step binds what the next one uses, as a lambda computes its input anew
    wherever it is named.
    """
    form = "^([0-9]+)(?:-([0-9]+))?$"
    texts = F.transform(
        F.split(inner, ","),
        lambda item: F.struct(
            item.alias("text"),
            F.regexp_extract(item, form, 1).alias("low"),
            F.regexp_extract(item, form, 2).alias("high"),
        ),
    )
    bounds = F.transform(
        texts,
        lambda t: F.struct(
            t["text"].alias("text"),
            F.length(t["low"]).alias("width"),
            (t["high"] == "").alias("single"),
            F.when(t["high"] != "", t["low"].try_cast("bigint")).alias("low"),
            F.when(t["high"] != "", t["high"].try_cast("bigint")).alias("high"),
        ),
    )

    def checked(b: Column) -> Column:
        span = b["high"] - b["low"]
        error = (
            F.when(b["width"] == 0, BAD_RANGE)
            .when(b["single"], F.lit(None).cast("string"))
            .when(span.isNull(), LONG_RANGE)
            .when(span < 0, BACKWARDS)
            .when(_too_large(span, max_size), LONG_RANGE)
        )
        return F.struct(
            b["text"].alias("text"),
            error.alias("error"),
            b["low"].alias("low"),
            b["high"].alias("high"),
            b["width"].alias("width"),
            F.when((span >= 0) & ~_too_large(span, max_size), span + 1)
            .otherwise(F.lit(1).cast("bigint"))
            .alias("size"),
        )

    return F.transform(bounds, checked)


def _piece(token: Column, max_size: int | None) -> Column:
    """Text before a bracket and the ranges inside it (none if there is no bracket)."""
    at = F.instr(token, "[")
    inner = token.substr(at + 1, F.length(token) - at - 1)
    return F.struct(
        F.when(at == 0, token).otherwise(F.left(token, at - 1)).alias("prefix"),
        F.when(at > 0, _ranges(inner, max_size)).alias("ranges"),
    )


def _size(piece: Column) -> Column:
    one = F.lit(1).cast("bigint")
    total = F.aggregate(piece["ranges"], F.lit(0).cast("bigint"), lambda n, r: n + r["size"])
    return F.when(piece["ranges"].isNull(), one).otherwise(total)


def _number_text(r: Column, at: Column) -> Column:
    """Zero-padded text of a number of a range; longer numbers keep their digits."""
    number = (r["low"] + at).cast("string")
    padded = F.lpad(number, F.greatest(r["width"], F.length(number)), F.lit("0"))
    return F.when(r["low"].isNull(), r["text"]).otherwise(padded)


def _option(piece: Column, at: Column) -> Column:
    """What a piece stands for at a place among its options."""
    begin = F.struct(at.alias("left"), F.lit(None).cast("string").alias("text"))

    def step(acc: Column, r: Column) -> Column:
        here = acc["text"].isNull() & (acc["left"] < r["size"])
        return F.struct(
            F.when(acc["text"].isNull() & ~here, acc["left"] - r["size"]).otherwise(acc["left"]).alias("left"),
            F.when(here, _number_text(r, acc["left"])).otherwise(acc["text"]).alias("text"),
        )

    found = F.aggregate(piece["ranges"], begin, step, lambda acc: acc["text"])
    return F.when(piece["ranges"].isNull(), piece["prefix"]).otherwise(F.concat(piece["prefix"], found))


def _name(pieces: Column, number: Column) -> Column:
    """The name of a part at a number; the leftmost option varies slowest."""
    begin = F.struct(number.alias("left"), F.lit("").alias("name"))

    def step(acc: Column, piece: Column) -> Column:
        size = _size(piece)
        return F.struct(
            F.floor(acc["left"] / size).cast("bigint").alias("left"),
            F.concat(_option(piece, acc["left"] % size), acc["name"]).alias("name"),
        )

    return F.aggregate(F.reverse(pieces), begin, step, lambda acc: acc["name"])


def expand_hosts(
    df: DataFrame,
    col: str,
    keys: Sequence[str],
    allow_duplicates: bool = False,
    sort: bool = False,
    max_size: int | None = None,
) -> DataFrame:
    """Rows ``(*keys, host, part_no, item_no, error)`` of the expressions in ``col``.

    ``keys`` identify an expression. ``(part_no, item_no)`` is the place of a
    host in the written order; a duplicate keeps its first place. ``max_size``
    makes larger ranges and parts errors; ``MAX_SIZE`` is the usual limit.
    """
    # an expression is short and stands for many names: those of a small file are dealt out before they are expanded
    tasks = _TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(*keys, col).repartition(tasks).select(
        *keys,
        _bracket_error(F.col(col)).alias("__bracket"),
        F.regexp_extract_all(col, F.lit(r"((?:[^,\[]|\[[^\]]*\])+)"), F.lit(1)).alias("__parts"),
    )
    pieces = parts.select(
        *keys,
        "__bracket",
        F.transform(
            "__parts",
            lambda part: F.transform(
                F.filter(
                    F.regexp_extract_all(part, F.lit(r"([^\[]*\[[^\]]*\]|[^\[]+)"), F.lit(1)),
                    lambda token: token != "",
                ),
                lambda token: _piece(token, max_size),
            ),
        ).alias("__pieces"),
    )

    def part_error(part: Column) -> Column:
        ranges = F.flatten(
            F.transform(part, lambda p: F.coalesce(p["ranges"], F.array().cast(_RANGES)))
        )
        bad = F.filter(ranges, lambda r: r["error"].isNotNull())
        size = F.aggregate(part, F.lit(1.0), lambda n, p: n * _size(p))
        return F.coalesce(F.get(bad, F.lit(0))["error"], F.when(_too_large(size, max_size), LARGE))

    checked = pieces.withColumn(
        "error",
        F.coalesce(
            "__bracket",
            F.get(
                F.filter(F.transform("__pieces", part_error), lambda e: e.isNotNull()), F.lit(0)
            ),
        ),
    )
    wrong = checked.where("error is not null").select(
        *keys,
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("int").alias("part_no"),
        F.lit(None).cast("bigint").alias("item_no"),
        "error",
    )
    right = checked.where("error is null").select(*keys, F.posexplode("__pieces").alias("part_no", "__part"))
    total = F.aggregate("__part", F.lit(1).cast("bigint"), lambda n, p: n * _size(p))
    out = (
        _numbered(right, total, "item_no")
        .select(
            *keys, _name(F.col("__part"), F.col("item_no")).alias("host"), "part_no", "item_no",
            F.lit(None).cast("string").alias("error"),
        )
        .unionByName(wrong)
    )
    if not allow_duplicates:
        out = (
            out.groupBy(*keys, "host")
            .agg(F.min(F.struct("part_no", "item_no")).alias("__at"), F.max("error").alias("error"))
            .select(*keys, "host", "__at.part_no", "__at.item_no", "error")
        )
    out = out.select(*keys, "host", "part_no", "item_no", "error")
    return out.orderBy(*keys, natural_key("host")) if sort else out


_RANGES = "array<struct<text:string,error:string,low:bigint,high:bigint,width:int,size:bigint>>"


def expand_tasks_per_node(
    df: DataFrame, col: str, keys: Sequence[str], max_size: int | None = None
) -> DataFrame:
    """Rows ``(*keys, node_idx, tasks, error)`` of lists such as ``2(x3),1``.

    ``max_size`` makes larger repetitions errors.
    """
    form = r"^([0-9]+)(?:\(x([0-9]+)\))?$"

    def run(part: Column) -> Column:
        times = F.regexp_extract(part, form, 2)
        n = F.when(times == "", F.lit(1).cast("bigint")).otherwise(times.try_cast("bigint"))
        error = F.when(~part.rlike(form), BAD_TASKS).when(
            n.isNull() | _too_large(n, max_size), LONG_TASKS
        )
        return F.struct(
            F.regexp_extract(part, form, 1).try_cast("bigint").alias("tasks"),
            n.alias("n"),
            error.alias("error"),
        )

    runs = df.select(*keys, F.transform(F.split(col, ","), run).alias("__runs")).withColumn(
        "error",
        F.get(F.filter("__runs", lambda r: r["error"].isNotNull()), F.lit(0))["error"],
    )
    starts = F.aggregate(
        "__runs",
        F.array(F.lit(0).cast("bigint")),
        lambda done, r: F.concat(done, F.array(F.element_at(done, -1) + r["n"])),
    )
    repeated = (
        runs.where("error is null")
        .select(*keys, F.inline(F.arrays_zip("__runs", F.slice(starts, F.lit(1), F.size("__runs")).alias("start"))))
        .where("__runs.n > 0")
    )
    nodes = _numbered(repeated, F.col("__runs.n"), "__at").select(
        *keys, (F.col("start") + F.col("__at")).alias("node_idx"), F.col("__runs.tasks").alias("tasks")
    )
    bad = runs.where("error is not null").select(
        *keys,
        F.lit(None).cast("bigint").alias("node_idx"),
        F.lit(None).cast("bigint").alias("tasks"),
        "error",
    )
    return nodes.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


# ---------------------------------------------------------------------------
# collapse
# ---------------------------------------------------------------------------

_DIGITS = (18, 37)  # digits that fit a bigint, and a decimal; those before them in a longer number go with its prefix
_NO_NUMBER = -1
_KEPT_PASSES = 4  # passes after which a plan is cut
_ISLAND_BLOCK = 1 << 16


def _padded(number: Column, width: Column) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


def _islands(df: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Runs of consecutive ``num`` per key as (low, high), built block-wise.

    A run is found inside a block of the number axis. Only runs that reach a border
    of their block, at most two of each, are then looked at along the whole axis.
    """
    inside = Window.partitionBy(*keys, "__block").orderBy("num")
    runs = (
        df.withColumn("__block", F.floor(F.col("num") / block))
        .withColumn("__run", (F.col("num") - F.row_number().over(inside)).cast(df.schema["num"].dataType))
        .groupBy(*keys, "__block", "__run")
        .agg(F.min("num").alias("low"), F.max("num").alias("high"))
        .withColumn("__border", (F.col("low") % block == 0) | ((F.col("high") + 1) % block == 0))
    )
    along = Window.partitionBy(*keys).orderBy("low")
    starts = (F.coalesce(F.lag("high").over(along), F.lit(-2)) != F.col("low") - 1).cast("int")
    merged = (
        runs.where("__border")
        .withColumn("__start", starts)
        .withColumn("__run", F.sum("__start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__run")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("__run")
    )
    return merged.unionByName(runs.where("not __border").select(*keys, "low", "high"))


def _joined_ranges(ranges: Column, number: str) -> Column:
    """Join zero-padded runs to unpadded ones at powers of ten.

    ``ranges`` holds all runs of one prefix and suffix as (low, high, width),
    width 0 for unpadded numbers. 08-09 goes on with 10, so a padded run that
    ends just below a power of ten takes over the unpadded numbers from there,
    unless an unpadded range that began earlier is already running through it. ``number`` is the type of the ends.
    """
    chains = f"array<struct<low:{number},high:{number},width:int>>"

    def ends_low(r: Column) -> Column:
        """All nines, with one digit less than the width: the next number is unpadded."""
        text = r["high"].cast("string")
        return (F.length(text) == r["width"] - 1) & text.rlike("^9+$")

    padded = F.filter(ranges, lambda r: r["width"] > 0)
    tails = F.array_sort(
        F.transform(
            F.filter(padded, ends_low),
            lambda r: F.struct(
                r["width"].alias("width"), r["low"].alias("low"), r["high"].alias("high")
            ),
        )
    )

    def claim(state: Column, tail: Column) -> Column:
        """Offer one padded tail to the range that is running."""
        now = state["now"]
        fits = (tail["high"] + 1 >= state["first"]) & (tail["high"] + 1 <= now["high"])
        begins = tail["high"] + 1 == state["first"]
        earlier = tail["low"] < now["low"]
        taken = F.struct(
            tail["low"].alias("low"), now["high"].alias("high"), tail["width"].alias("width")
        )
        cut = F.struct(
            now["low"].alias("low"), tail["high"].alias("high"), now["width"].alias("width")
        )
        win = fits & (begins | earlier)
        return F.struct(
            state["first"].alias("first"),
            F.when(win & ~begins, F.concat(state["done"], F.array(cut)))
            .otherwise(state["done"])
            .alias("done"),
            F.when(win, taken).otherwise(now).alias("now"),
            F.when(win, F.concat(state["used"], F.array(tail["width"])))
            .otherwise(state["used"])
            .alias("used"),
        )

    def run(natural: Column) -> Column:
        begin = F.struct(
            natural["low"].alias("first"),
            F.array().cast(chains).alias("done"),
            F.struct(
                natural["low"].alias("low"),
                natural["high"].alias("high"),
                F.length(natural["low"].cast("string")).alias("width"),
            ).alias("now"),
            F.array().cast("array<int>").alias("used"),
        )
        return F.aggregate(
            tails,
            begin,
            claim,
            lambda s: F.struct(
                F.concat(s["done"], F.array(s["now"])).alias("ranges"), s["used"].alias("used")
            ),
        )

    runs = F.transform(F.filter(ranges, lambda r: r["width"] == 0), run)
    used = F.flatten(F.transform(runs, lambda r: r["used"]))
    alone = F.filter(padded, lambda r: ~(ends_low(r) & F.array_contains(used, r["width"])))
    natural = F.flatten(F.transform(runs, lambda r: r["ranges"]))
    chain = lambda r: F.struct(r["low"], r["width"], r["high"])
    joined = F.concat(F.transform(natural, chain), F.transform(alone, chain))
    as_they_are = F.transform(
        ranges,
        lambda r: F.struct(
            r["low"].alias("low"),
            F.when(r["width"] == 0, F.length(r["low"].cast("string"))).otherwise(r["width"]).alias("width"),
            r["high"].alias("high"),
        ),
    )
    return F.array_sort(F.when(F.exists(padded, ends_low), joined).otherwise(as_they_are))


def _collapse_once(df: DataFrame, by: Sequence[str], block: int, most: int) -> DataFrame:
    """Fold the rightmost number of ``left`` into a range expression in ``right``.

    A name without one moves to ``right`` as it is written: it gets the width
    ``_NO_NUMBER``. Of a number of more than ``most`` digits the last of them are folded.
    """
    kind = "bigint" if most <= _DIGITS[0] else "decimal(38,0)"
    digits = F.regexp_extract("left", rf"([0-9]{{1,{most}}})[^0-9]*$", 1)
    tail = F.regexp_extract("left", r"([^0-9]*)$", 1)
    usable = F.col("__digits") != ""
    cut = F.length("left") - F.length("__digits") - F.length("__tail")
    longer = F.substring("left", cut, F.lit(1)).rlike("[0-9]") & (cut > 0)
    padded = (F.col("__digits").startswith("0") & (F.length("__digits") > 1)) | longer
    numbered = df.withColumns({"__digits": digits, "__tail": tail}).select(
        *by,
        F.when(usable, F.left("left", cut)).otherwise(F.lit("")).alias("prefix"),
        F.when(usable, F.concat("__tail", "right"))
        .otherwise(F.concat("left", "right"))
        .alias("suffix"),
        F.when(~usable, _NO_NUMBER)
        .when(padded, F.length("__digits"))
        .otherwise(0)
        .alias("width"),
        F.when(usable, F.col("__digits").try_cast(kind)).otherwise(F.lit(0).cast(kind)).alias("num"),
    )
    group = [*by, "prefix", "suffix"]
    ranges = (
        _islands(numbered, [*group, "width"], block)
        .groupBy(*group)
        .agg(F.collect_list(F.struct("low", "width", "high")).alias("__ranges"))
    )
    fixed = F.get("__ranges", F.lit(0))["width"] == _NO_NUMBER
    ranges = ranges.withColumn(
        "__joined",
        F.when(fixed, F.col("__ranges")).otherwise(_joined_ranges(F.col("__ranges"), kind)),
    )
    texts = F.transform(
        "__joined",
        lambda r: F.when(r["low"] == r["high"], _padded(r["low"], r["width"])).otherwise(
            F.concat(_padded(r["low"], r["width"]), F.lit("-"), _padded(r["high"], r["width"]))
        ),
    )
    first = F.get("__joined", F.lit(0))
    number = F.when((F.size("__joined") == 1) & (first["low"] == first["high"]), F.get(texts, F.lit(0)))
    number = F.when(fixed, F.lit("")).otherwise(
        F.coalesce(number, F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
    )
    return ranges.select(
        *by, F.col("prefix").alias("left"), F.concat(number, F.col("suffix")).alias("right")
    )


def collapse_hosts(
    df: DataFrame,
    by: Sequence[str],
    host: str,
    numeric_fields: int | None = None,
    block: int = _ISLAND_BLOCK,
) -> DataFrame:
    """Rows ``(*by, hostlist, error)``: the short written form of each group's hosts.

    Names are trimmed, blanks and duplicates dropped. A name with a bracket or
    comma sets ``error`` of its group; the others are still collapsed. The numbers of a name are folded into
    ranges from the right, each by a pass of its own, as many as the name with most numbers has (a small job
    finds that), or the last ``numeric_fields`` of them. Numbers up to 37 digits are folded whole.
    """
    names = df.select(*by, F.trim(host).alias("left")).where("left <> ''").distinct()
    # forbidden names go along as one row of their group without a number
    forbidden = F.col("left").rlike(r"[\[\],]")
    marked = names.select(*by, F.when(~forbidden, F.col("left")).otherwise("").alias("left"), forbidden.alias("__bad"))
    parts = marked.distinct().withColumn("right", F.lit(""))
    numbers = F.regexp_extract_all("left", F.lit("[0-9]+"), F.lit(0))
    longest = F.array_max(F.transform(numbers, lambda n: F.length(n)))
    counted = names.agg(F.max(F.size(numbers)).alias("fields"), F.max(longest).alias("digits")).first()
    most = _DIGITS[(counted["digits"] or 0) > _DIGITS[0]]
    for n in range((counted["fields"] or 0) if numeric_fields is None else numeric_fields):
        if n and n % _KEPT_PASSES == 0:
            parts = kept(parts, "hosts")
        parts = _collapse_once(parts, [*by, "__bad"], block, most)
    part = F.when(~F.col("__bad"), F.concat("left", "right"))
    return parts.groupBy(*by).agg(
        F.nullif(F.array_join(F.array_sort(F.collect_list(part)), ","), F.lit("")).alias("hostlist"),
        F.max(F.when(F.col("__bad"), FORBIDDEN)).alias("error"),
    )
