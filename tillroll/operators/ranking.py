"""Distributed global ranking, quantile buckets and exact percentiles.

A window with ``ORDER BY`` but no ``PARTITION BY`` (``ntile``, ``row_number``
over a whole table) makes Spark move every row into one task.  The operators
here compute the same numbers without one:

``select_ranks``
    exact order statistics of columns by radix selection: the values become
    integer keys in the same order; the rows under the chosen prefix are counted
    by their next 16 bits (in each task first, so at most 65,536 counts a target
    and task are shuffled, never the values), the digit that holds the wanted rank
    is appended, and so on for each digit of the key range.  No sketch, no bracket
    that could grow with the data.  Several columns share every pass.
``select_text_ranks``
    the same for text keys: digits are the next two bytes.
``exact_percentile`` / ``exact_percentiles`` / ``summarize_with_percentile``
    ``PERCENTILE_CONT`` from the one or two order statistics it interpolates.
``ntile_buckets``
    ``NTILE(k)`` over several metrics from their ``k - 1`` boundary rows: values by
    ``select_ranks``, ids among the rows tied with a boundary value by the same
    counting; only counts are shuffled.
``global_row_number``
    a dense number for every row: range-partition on the (total) order, sort
    inside each partition, number rows with ``monotonically_increasing_id``
    (partition index in the upper bits, position in the lower 33 bits),
    materialise the result with a reliable ``checkpoint()`` so both passes see
    the same partitions, then add the row counts of all earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import ensure_checkpoint_dir

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1
_LOWEST = -(1 << 63)


def _order_cols(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def global_row_number(df: DataFrame, order, name: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total ``order``.

    ``order`` is a list of column names or sort expressions (``F.desc(...)``,
    ``F.col(..).asc_nulls_last()``); it should end with a unique key so that
    the numbering is repeatable.  Equivalent to
    ``row_number() OVER (ORDER BY order)`` without a single-partition window.
    """
    cols = _order_cols(order)
    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count the range shuffle uses spark.sql.shuffle.partitions
    # and AQE may merge adjacent small ranges; merged ranges stay in order, and the
    # checkpoint below fixes the partition ids both passes see.
    by_range = (df.repartitionByRange(num_partitions, *cols) if num_partitions
                else df.repartitionByRange(*cols))
    return _numbered(by_range.sortWithinPartitions(*cols), name)


def number_in_place(df: DataFrame, name: str) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the order of partitions and rows.

    No shuffle: for frames whose partitions are in the wanted order already.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return _numbered(df, name)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    ranked = df.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _POS_BITS)
    counts = ranked.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"))
    # One row per partition: the bounded table is numbered in a single task, and
    # checkpointed, or every later evaluation would recount the whole ranking.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")).checkpoint(eager=True)
    return (ranked.join(F.broadcast(offsets), pid == F.col("_pid"), "inner")
                  .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_POS_MASK)) + 1)
                  .drop("_mid", "_pid", "_off"))


def with_surrogate_id(df: DataFrame, order, name: str = "review_sk",
                      num_partitions: int | None = None) -> DataFrame:
    """Dense, repeatable ``BIGSERIAL``-style key 1..N following ``order``."""
    return global_row_number(df, order, name, num_partitions)


# ---------------------------------------------------------------------------
# order statistics

def order_key(df: DataFrame, name: str) -> Column:
    """64-bit integer that sorts like the numeric column ``name`` (NULL stays NULL).

    Integers are their own key and decimals of up to 18 digits their unscaled
    value; doubles use their bit pattern, negative ones mirrored.
    """
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(10 ** kind.scale)).cast("long")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = c.cast("double") + F.lit(0.0)                          # -0.0 and 0.0 are one value
        bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
        return F.when(c.isNotNull(), F.when(bits >= 0, bits).otherwise(F.lit(_LOWEST) - bits - 1))
    raise TypeError(f"{name} is {kind.simpleString()}; ranks need an integer, decimal(<=18) or double column")


def key_span(keyed: DataFrame) -> dict[int, tuple[int, int]]:
    """Smallest and largest ``key`` of every group ``g`` (a few numbers), without NULLs."""
    return {g: (lo, hi) for g, (lo, hi, _) in _spans(keyed).items()}


def _spans(keyed: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Smallest and largest ``key`` and number of rows of every group, without NULLs."""
    rows = keyed.where("key is not null").groupBy("g").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    return {r["g"]: (r["lo"], r["hi"], r["n"]) for r in rows}


def select_ranks(rows: DataFrame, targets: DataFrame, span: dict[int, tuple[int, int]]) -> DataFrame:
    """(g, t, key, nth) for every target: the key at its rank, and the rank among the rows of that key.

    ``rows`` (g, key, n) stand for ``n`` rows each of the small-integer group ``g``;
    ``targets`` are a few rows (g, t, rank) with ranks from 1 within the group; ``span``
    is the key range of each group, which decides how many 16-bit digits there are.
    Targets beyond the rows drop out.  ``rows`` are read once a digit and so should be
    cheap to read; of each digit only the targets' places are kept, on the driver, and the
    last digit is left to the plan that is returned.
    """
    bits = max([1, *((hi - lo).bit_length() for lo, hi in span.values())])
    if bits > 62:                                                           # whole range: as unsigned keys
        bits, base = 64, {}
        to_digits = from_digits = lambda key: key.bitwiseXOR(F.lit(_LOWEST))        # noqa: E731
    else:
        base = F.lit(0).cast("long")
        for g, (lo, _) in span.items():
            base = F.when(F.col("g") == g, F.lit(lo).cast("long")).otherwise(base)
        to_digits, from_digits = (lambda key: key - base), (lambda key: key + base)
    flipped = rows.select("g", to_digits(F.col("key")).alias("u"), "n")
    state = [(r["g"], r["t"], 0, r["rank"]) for r in targets.select("g", "t", "rank").collect()]
    shifts = range((bits - 1) // 16 * 16, -1, -16)
    for shift in shifts:
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")
        above = F.lit(0).cast("long") if shift == shifts[0] else F.shiftrightunsigned("u", shift + 16)
        found = _at_digit(flipped.select("g", above.alias("prefix"), digit, "n"), state, targets.schema["t"].dataType).select(
            "g", "t", F.shiftleft("prefix", 16).bitwiseOR(F.col("digit")).alias("prefix"), "nth")
        if shift != shifts[-1]:
            state = [tuple(r) for r in found.collect()]                                             # one row a target
    return found.select("g", "t", from_digits(F.col("prefix")).alias("key"), "nth")


def _at_digit(under: DataFrame, state: list[tuple], kind: T.DataType) -> DataFrame:
    """(g, prefix, t, nth, digit, n) of the targets ``state`` (g, t, prefix, nth): the digit that holds each one.

    ``under`` (g, prefix, digit, n) is counted below the targets' prefixes only; ``nth``
    becomes the rank within the digit, whose rows are ``n``.
    """
    places: dict[tuple, list] = {}
    for g, t, prefix, nth in state:
        places.setdefault((g, prefix), []).append((t, nth))
    wanted = F.array().cast(T.ArrayType(T.StructType([T.StructField("t", kind), T.StructField("nth", T.LongType())])))
    below = F.lit(False)
    for (g, prefix), some in places.items():
        here = (F.col("g") == g) & (F.col("prefix") == F.lit(prefix))
        wanted = F.when(here, F.array(*[F.struct(F.lit(t).cast(kind).alias("t"), F.lit(nth).cast("long").alias("nth"))
                                        for t, nth in some])).otherwise(wanted)
        below = below | here
    hist = under.where(below).groupBy("g", "prefix", "digit").agg(F.sum("n").alias("n"))
    # at most 65,536 digits a prefix
    upto = Window.partitionBy("g", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("last", F.sum("n").over(upto)).withColumn("target", F.explode(wanted))
    nth = F.col("target.nth")
    return cum.where((nth <= F.col("last")) & (nth > F.col("last") - F.col("n"))).select(
        "g", "prefix", F.col("target.t").alias("t"), (nth - F.col("last") + F.col("n")).alias("nth"), "digit", "n")


# Ids under a prefix that are put in order at once.
FEW_IDS = 4096


def select_text_ranks(rows: DataFrame, targets: list[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """{(g, rank): id} of ``rows`` (g, id), whose text or binary ids are distinct within a group.

    The ids that begin with the bytes found so far are counted by their next two (an id
    that ends counts as a smaller digit), until few are left under each target's prefix;
    these few are put in order.  Targets beyond the rows are not in the result.
    """
    raw = rows.select("g", F.col("id").cast("binary").alias("b"), "id")
    open_ = [(g, rank, b"", rank) for g, rank in targets]
    few: list[tuple] = []
    length = 0
    while open_:
        under = raw.select("g", F.substring("b", 1, length).alias("prefix"), F.substring("b", length + 1, 2).alias("digit"),
                           F.lit(1).cast("long").alias("n"))
        found = _at_digit(under, open_, T.LongType()).collect()                                   # one row a target
        length += 2
        open_ = []
        for r in found:
            place = (r["g"], r["t"], bytes(r["prefix"] + r["digit"]), r["nth"])
            (few if r["n"] <= FEW_IDS or len(place[2]) < length else open_).append(place)
    out = {}
    for size in sorted({len(f[2]) for f in few}):
        state = rows.sparkSession.createDataFrame([f for f in few if len(f[2]) == size], "g int, t long, prefix binary, nth long")
        left = raw.withColumn("prefix", F.substring("b", 1, size)).join(F.broadcast(state), ["g", "prefix"])
        # of the few ids that begin so, an id that ended inside its last digit is the first
        lists = left.groupBy("g", "t", "nth").agg(F.sort_array(F.collect_list(F.struct("b", "id"))).alias("ids"))
        out |= {(r["g"], r["t"]): r["id"] for r in lists.select("g", "t", F.get("ids", F.col("nth").cast("int") - 1)["id"].alias("id")).collect()}
    return out


def _percentile_key(df: DataFrame, col: str, per_unit: int | None) -> Column:
    return F.round(F.col(col).cast("double") * F.lit(float(per_unit))).cast("long") if per_unit else order_key(df, col)


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[str, float, int | None]], materialized: bool = False) -> DataFrame:
    """One row with, for each ``name: (column, p, per_unit)``, ``PERCENTILE_CONT(p) WITHIN GROUP (ORDER BY column)`` as a double.

    NULLs are ignored; a column without values gives a NULL.  The two neighbouring order
    statistics are interpolated as lo + (hi - lo) * fraction.  ``per_unit`` says that the
    values are whole multiples of 1 / ``per_unit`` (microseconds in days, say): fewer
    digits then tell them apart than a double's 64 bits.  All columns share the passes
    over their narrow keys, which are checkpointed first unless ``df`` is
    ``materialized`` already.
    """
    names = list(wanted)
    parts = [F.struct(F.lit(g).alias("g"), _percentile_key(df, c, unit).alias("key"), F.col(c).cast("double").alias("v"))
             for g, (c, _, unit) in enumerate(wanted.values())]
    stacked = (df.select(F.explode(F.array(*parts)).alias("m")).select("m.*") if len(parts) > 1 else
               df.select(parts[0].alias("m")).select("m.*"))
    keyed = stacked.where("key is not null").withColumn("n", F.lit(1).cast("long"))
    ensure_checkpoint_dir(df.sparkSession)
    if not materialized:
        keyed = keyed.checkpoint(eager=True)
    spans = _spans(keyed)
    ranks, fractions = [], {}
    for g, (_, p, _) in enumerate(wanted.values()):
        if g in spans:
            place = (spans[g][2] - 1) * float(p)
            low = int(place // 1)
            fractions[g] = place - low
            ranks += [(g, 0, low + 1), (g, 1, low + 1 + (fractions[g] > 0))]
    targets = df.sparkSession.createDataFrame(ranks, "g int, t int, rank long")
    found = select_ranks(keyed.select("g", "key", "n"), targets, {g: s[:2] for g, s in spans.items()})
    values = keyed.join(F.broadcast(found.select("g", "key").distinct()), ["g", "key"])              # two a column
    lo = [F.min(F.when(F.col("g") == g, F.col("v"))) for g in range(len(names))]
    hi = [F.max(F.when(F.col("g") == g, F.col("v"))) for g in range(len(names))]
    return values.agg(*[(lo[g] + (hi[g] - lo[g]) * F.lit(fractions.get(g, 0.0))).alias(name) for g, name in enumerate(names)])


def exact_percentile(df: DataFrame, col: str, p: float = 0.5, per_unit: int | None = None,
                     materialized: bool = False) -> DataFrame:
    """One-row frame ``value``: ``exact_percentiles`` of one column."""
    return exact_percentiles(df, {"value": (col, p, per_unit)}, materialized)


def summarize_with_percentile(df: DataFrame, aggs, col: str, p: float = 0.5, name: str = "value",
                              per_unit: int | None = None, materialized: bool = False) -> DataFrame:
    """One-row frame: the global aggregates ``aggs`` and ``name`` = the exact percentile of ``col``."""
    return df.agg(*aggs).withColumn(name, exact_percentile(df, col, p, per_unit, materialized).scalar())


# ---------------------------------------------------------------------------
# quantile buckets

def ntile_buckets(df: DataFrame, k: int, metrics: dict[str, tuple[str, bool]], id_col: str) -> DataFrame:
    """Add for each ``name: (column, descending)`` of ``metrics`` ``NTILE(k) OVER (ORDER BY column, id)`` as ``long``.

    NULLs come last in ascending and first in descending order; ``id_col`` is unique
    and text, binary or a type of ``order_key``.  A row's bucket is one more than the
    number of boundary rows (the last rows of the buckets but the last) that come before
    it.  Boundary values are selected by digits of the metrics, all in one pass, and
    boundary ids by digits of the ids tied with them, so neither values nor ids are
    shuffled or sorted, however many are tied.  ``df`` is read once a digit.
    """
    keys = [-order_key(df, c) if descending else order_key(df, c) for c, descending in metrics.values()]

    def stacked():
        return F.explode(F.array(*[F.struct(F.lit(g).alias("g"), key.alias("key")) for g, key in enumerate(keys)])).alias("m")

    found = df.select(stacked()).select("m.*").groupBy("g").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    span, total = {}, max([0, *(r["n"] for r in found)])
    for r in found:
        g, descending = r["g"], list(metrics.values())[r["g"]][1]           # NULL becomes the next key outside
        lo, hi = (r["lo"], r["hi"]) if r["lo"] is not None else (0, 0)
        keys[g] = F.coalesce(keys[g], F.lit(lo - 1 if descending else hi + 1).cast("long"))
        span[g] = (lo - 1, hi) if descending else (lo, hi + 1)
    ends = [(i, i * (total // k) + min(i, total % k)) for i in range(1, k)]
    ranks = [(g, i, rank) for g in range(len(keys)) for i, rank in ends if rank > 0]
    spark = df.sparkSession
    rows = df.select(stacked()).select("m.g", "m.key", F.lit(1).cast("long").alias("n"))
    targets = spark.createDataFrame(ranks, "g int, t int, rank long")
    at = select_ranks(rows, targets, span).collect() if ranks else []       # at most k - 1 a metric
    groups = {pair: h for h, pair in enumerate(sorted({(r["g"], r["key"]) for r in at}))}
    tied_keys = spark.createDataFrame([(g, key, h) for (g, key), h in groups.items()], "g int, key long, h int")
    tied = (df.select(F.col(id_col).alias("id"), stacked()).select("id", "m.*")
            .join(F.broadcast(tied_keys), ["g", "key"]).select(F.col("h").alias("g"), "id"))
    ids = _ids_at(tied, sorted({(groups[r["g"], r["key"]], r["nth"]) for r in at}))
    id_type = df.schema[id_col].dataType.simpleString()
    row = [F.struct(key.alias("key"), F.col(id_col).alias("id")) for key in keys]
    out = []
    for g, name in enumerate(metrics):
        places = sorted((r["key"], ids[groups[r["g"], r["key"]], r["nth"]]) for r in at if r["g"] == g)
        ended = [F.struct(F.lit(key).cast("long").alias("key"), F.lit(end).cast(id_type).alias("id")) for key, end in places]
        out.append(sum((F.when(end < row[g], F.lit(1)).otherwise(F.lit(0)) for end in ended), F.lit(1)).cast("long").alias(name))
    return df.select(*df.columns, *out)


def _ids_at(tied: DataFrame, targets: list[tuple[int, int]]) -> dict[tuple[int, int], object]:
    """{(g, rank): id} of ``tied`` (g, id) for a few targets."""
    if not targets:
        return {}
    if isinstance(tied.schema["id"].dataType, (T.StringType, T.BinaryType)):
        return select_text_ranks(tied, targets)
    keyed = tied.select("g", order_key(tied, "id").alias("key"), "id", F.lit(1).cast("long").alias("n"))
    wanted = tied.sparkSession.createDataFrame([(g, rank, rank) for g, rank in targets], "g int, t long, rank long")
    found = select_ranks(keyed.select("g", "key", "n"), wanted, key_span(keyed))
    at = keyed.join(F.broadcast(found.select("g", "t", F.col("key").alias("_k"))), "g").where("key = _k")
    return {(r["g"], r["t"]): r["id"] for r in at.select("g", "t", "id").collect()}
