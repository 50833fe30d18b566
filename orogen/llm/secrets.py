"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Base rules find assignments, access keys and hex runs in each whole text. The
method adds long mixed tokens that no base rule covers: every candidate value's
hash is aggregated by the distinct repositories and owners that hold it. A value
that many owners hold is a widely copied example; one that a single owner holds
is live-looking, and its wider occurrences are added to the spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import stored, text_of

# Fixed values of the contract: kinds in their listed order, with their patterns.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Wider candidates of the method: long runs that mix letters and digits.
WIDE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")


#: Items of a part in which :func:`running` combines; parts are combined apart from one another.
PART = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_parts(items: Column) -> Column:
    """An array cut into arrays of PART items."""
    steps = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.slice(items, i * PART + 1, F.lit(PART)))


def running(items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], item_type: str) -> Column:
    """Each item with the combination of the (int) values of all before it, 0 at first: array<struct<item, before>>.

    A long array is combined in parts, whose totals are combined first, so the
    work grows with the array and hardly with its square.
    """
    out_type = f"array<struct<item:{item_type},before:int>>"

    def of(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: combine(acc, value(x))))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(combine(F.element_at(acc, -1), t))))
        return F.flatten(F.zip_with(parts, starts, one))

    def one(part: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            pair = F.struct(x.alias("item"), acc["at"].alias("before"))
            return F.struct(combine(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(pair)).alias("out"))

        # There is a start more than there are parts; it meets a null part.
        empty = F.struct(start.alias("at"), F.array().cast(out_type).alias("out"))
        return F.coalesce(F.aggregate(part, empty, step, lambda acc: acc["out"]), F.array().cast(out_type))

    return let(items, lambda x: let(in_parts(x), of))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), in code points.

    The pieces between the matches and the matches themselves come from the
    same regular expression, so running sums of their lengths give positions.
    """
    rule = F.lit(pattern)
    # There is a gap more than there are matches; it meets a null match and is dropped.
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, rule, F.lit(0)), lambda gap, hit: F.when(hit.isNotNull(), F.struct(F.length(gap).alias("gap"), hit.alias("hit"))))
    pairs = F.filter(pairs, lambda p: p.isNotNull())
    placed = running(pairs, lambda p: p["gap"] + F.length(p["hit"]), lambda a, b: a + b, "struct<gap:int,hit:string>")

    def span(x: Column) -> Column:
        start = x["before"] + x["item"]["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["item"]["hit"])).alias("end"), x["item"]["hit"].alias("value"))

    return F.when(text.rlike(pattern), F.transform(placed, span)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def apart_from(base: Column, wide: Column) -> Column:
    """The ``wide`` spans that meet no ``base`` span; wide spans don't meet one another.

    In their common order a wide span must start after the ends of all base
    spans before it, and the next base span, if it is the next of all, after its end.
    """
    span = "struct<start:int,order:int,end:int,value:string>"
    both = F.array_sort(F.concat(base, wide))
    placed = running(both, lambda s: F.when(s["order"] < 3, s["end"]).otherwise(0), lambda a, b: F.greatest(a, b), span)

    def free(x: Column, following: Column) -> Column:
        clear = (x["item"]["order"] == 3) & (x["before"] <= x["item"]["start"])
        return F.when(clear & (following.isNull() | (following["item"]["start"] >= x["item"]["end"])), x["item"])

    found = let(placed, lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), free))
    return F.when((F.size(base) > 0) & (F.size(wide) > 0), F.filter(found, lambda w: w.isNotNull())).otherwise(wide)


def _kind(spans: Column, order: int) -> Column:
    """Spans with their kind's place; assignments carry the assigned value."""
    value = (lambda v: F.regexp_extract(v, ASSIGN_VALUE, 1)) if order == 0 else (lambda v: v)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), value(s["value"]).alias("value")))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``wide``: arrays of (start, order, end, value) of every whole text.

    Null counts as the empty text and gives empty arrays. Assignments whose
    value has under 6 characters are dropped after matching, as the contract
    says. Wide candidates that meet a base span are left to it.
    """
    text = text_of(text_col)
    assign = F.filter(_kind(matches(text, ASSIGN), 0), lambda s: F.length(s["value"]) >= 6)
    base = F.array_sort(F.concat(assign, _kind(matches(text, ACCESS), 1), _kind(matches(text, HEX), 2)))
    wide = _kind(matches(text, WIDE), 3)
    # Both are computed once a text: what a lambda names is a value, not an expression.
    both = let(F.struct(base.alias("base"), wide.alias("wide")), lambda x: F.struct(x["base"].alias("base"), apart_from(x["base"], x["wide"]).alias("wide")))
    found = df.withColumn("__spans", both)
    return found.withColumns({"base": F.col("__spans.base"), "wide": F.col("__spans.wide")}).drop("__spans")


def owner_of(repository: Column) -> Column:
    """The part of a repository's name before its first slash."""
    return F.substring_index(repository, "/", 1)


def ownership(found: DataFrame, repository_col: str = "source", *, widely: int = 3) -> DataFrame:
    """Per candidate hash: distinct repositories and owners, and whether it is an example.

    ``found`` comes from :func:`scan`. Holders are made distinct before they
    are counted, so a value in a third of all texts costs one row for each
    holder and task. Null repositories count as one unnamed holder.
    """
    repository = F.coalesce(F.col(repository_col).cast("string"), F.lit(""))
    held = found.select(repository.alias("repository"), F.explode(F.concat("base", "wide")).alias("s"))
    pairs = held.select(digest(F.col("s.value")).alias("hash"), "repository").distinct()
    per_owner = pairs.groupBy("hash", owner_of(F.col("repository")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    out = per_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    return out.withColumn("example", F.col("owners") >= widely)


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def label(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined; they are sorted by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"], s["end"])
    return F.concat_ws(",", F.transform(spans, one))


def detect(df: DataFrame, keep: list[str], text_col: str = "text", repository_col: str = "source", *, widely: int = 3) -> DataFrame:
    """All spans of every row, with how each value is owned across the corpus.

    Returns the columns ``keep`` (with ``repository_col`` among them or not) and
    ``base``, ``spans`` (base spans and single-owner wide tokens, sorted) and
    ``live`` (the spans whose value is no widely copied example).
    Scanned rows are written to the shared folder, so every text is scanned
    once; rows without any candidate take no part in a shuffle. Equal rows
    stay as many as they were; null and empty texts get empty arrays; an empty
    table gives none. A kept column named like an added one is replaced.
    """
    keep = [c for c in keep if c not in ("base", "wide", "spans", "live")]
    found = scan(df, text_col).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{repository_col}`").alias("__repository"), "base", "wide")
    any_found = (F.size("base") > 0) | (F.size("wide") > 0)
    found = stored(found, "secrets")
    some, none = found.where(any_found), found.where(~any_found)
    owned = ownership(some, "__repository", widely=widely)

    # A row is known by all its columns; equal rows are one with their number.
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in keep), "base", "wide"), {"ignoreNullFields": "false"}), 256)
    keyed = some.withColumn("__row", row)
    values = keyed.select("__row", "base", "wide").distinct().select("__row", F.explode(F.concat("base", "wide")).alias("s"))
    wanted = (F.col("s.order") < 3) | (F.col("owners") == 1)
    known = values.withColumn("hash", digest(F.col("s.value"))).join(owned, "hash").groupBy("__row").agg(
        F.array_sort(F.collect_list(F.when(wanted, F.col("s")))).alias("spans"),
        F.array_sort(F.collect_list(F.when(~F.col("example") & wanted, F.col("s")))).alias("live"),
    )
    rows = keyed.join(known, "__row").select(*keep, "base", "spans", "live")
    return none.select(*keep, "base", F.col("base").alias("spans"), F.col("base").alias("live")).unionByName(rows)


def redact(text: Column, spans: Column) -> Column:
    """The text with every span's characters replaced by a mark; overlapping spans merge.

    ``spans`` are sorted by their starts. The text is cut at every PART spans
    before it is cut at each, so long texts with many spans take no square of time.
    """
    placed = running(spans, lambda s: s["end"], lambda a, b: F.greatest(a, b), "struct<start:int,order:int,end:int,value:string>")

    def cut(parts: Column) -> Column:
        return F.array_join(F.transform(parts, one), "")

    def one(part: Column) -> Column:
        # From the end of what was replaced before the part to the start of its last span.
        first = F.get(part, F.lit(0))["before"]
        last = F.element_at(part, -1)["item"]["start"]
        own = F.when(last > first, F.substring(text, first + 1, last - first)).otherwise(F.lit(""))
        return let(F.struct(own.alias("text"), first.alias("at")), lambda o: F.array_join(F.transform(part, lambda x: piece(o, x)), ""))

    def piece(own: Column, x: Column) -> Column:
        start, before = x["item"]["start"], x["before"]
        return F.when(start >= before, F.concat(F.substring(own["text"], before - own["at"] + 1, start - before), F.lit("[SECRET]"))).otherwise(F.lit(""))

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    done = F.concat(let(placed, lambda p: let(in_parts(p), cut)), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(done)
