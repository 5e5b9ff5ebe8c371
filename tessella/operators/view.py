"""The table view: predicates, sort and ranked base as one immutable spec that compiles to a DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import natural_key
from tessella.sources.shared import folder

#: What a missing value sorts as, by column; other numbers sort as -1.
SENTINELS = {"score": -1.0, "silence_db": -999.0, "min_gap_s": -1.0, "min_sound_s": -1.0, "chops": -1.0, "level": -999.0, "lufs": -999.0, "final_db": -999.0}
#: The most distinct texts for tick boxes, the most keywords shown, and the open end of a range.
TICK_LIMIT, KEYWORD_LIMIT, OPEN_MAX = 25, 500, 1e18
FULL_RANGE = 1e-9
#: Bits of a row's number within its partition, in Spark's increasing ids.
WITHIN_BITS = 33


@dataclass(frozen=True)
class ViewSpec:
    """What the table shows. ``text`` must all be found among ``text_fields``."""

    text: str = ""
    text_fields: tuple[str, ...] = ("filename", "library", "supplier", "description", "tags")
    contains: dict[str, str] = field(default_factory=dict)
    allowed: dict[str, frozenset] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    sort: str | None = None
    descending: bool = False
    ranked: bool = False

    def with_keyword(self, token: str) -> ViewSpec:
        """A clicked keyword becomes one more term, once."""
        have = self.text.lower().split(" ")
        return self if token.lower() in have else replace(self, text=f"{self.text} {token}".strip())

    def cleared(self) -> ViewSpec:
        """No filters and no ranked base; a score sort stays."""
        return ViewSpec(text_fields=self.text_fields, sort=self.sort if self.sort == "score" else None, descending=self.descending if self.sort == "score" else False)

    def clicked(self, column: str) -> ViewSpec:
        """A header click sorts by the column, a second one turns the order around."""
        return replace(self, sort=column, descending=self.sort == column and not self.descending)


def text_filter(text: str, fields: tuple[str, ...]) -> Column | None:
    """Every term, split at spaces only, is a substring of the joined fields."""
    terms = [t for t in text.lower().split(" ") if t]
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in fields)))
    return reduce(lambda a, b: a & b, (F.contains(joined, F.lit(t)) for t in terms)) if terms else None


def column_filter(column: str, needle: str) -> Column | None:
    """A case-insensitive substring of one column."""
    needle = needle.strip().lower()
    return F.contains(F.lower(F.col(column).cast("string")), F.lit(needle)) if needle else None


def allow_filter(column: str, allowed) -> Column | None:
    """One of the ticked values; nothing ticked is no filter, and blanks are never offered."""
    values = sorted(v for v in allowed if v != "")
    return F.col(column).isin(values) if values else None


def range_filter(column: str, low: float | None, high: float | None, bounds: tuple[float, float] | None = None) -> Column | None:
    """low..high inclusive, without missing values; the whole range of the data is no filter at all."""
    if low is None and high is None:
        return None
    if bounds and (low is None or low <= bounds[0] + FULL_RANGE) and (high is None or high >= bounds[1] - FULL_RANGE):
        return None
    return F.col(column).between(F.lit(low if low is not None else -OPEN_MAX), F.lit(high if high is not None else OPEN_MAX))


def predicates(spec: ViewSpec, bounds: dict[str, tuple[float, float]] | None = None) -> list[Column]:
    found = [text_filter(spec.text, spec.text_fields)]
    found += [column_filter(c, x) for c, x in spec.contains.items()]
    found += [allow_filter(c, x) for c, x in spec.allowed.items()]
    found += [range_filter(c, *x, (bounds or {}).get(c)) for c, x in spec.ranges.items()]
    return [p for p in found if p is not None]


def sort_key(df: DataFrame, column: str) -> Column:
    """Numbers with their missing value's stand-in, texts in natural order."""
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return natural_key(F.coalesce(F.col(column), F.lit("")))
    return F.coalesce(F.col(column).cast("double"), F.lit(SENTINELS.get(column, -1.0)))


def matching(df: DataFrame, spec: ViewSpec, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The rows that the view shows, in any order."""
    return reduce(lambda d, p: d.where(p), predicates(spec, bounds), df)


def apply(df: DataFrame, spec: ViewSpec, key: str = "path", bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The rows that the view shows, in its order; ties by ``key``. A ranked base keeps its rank unless a column is chosen."""
    shown = matching(df, spec, bounds)
    if spec.sort is None:
        return shown.orderBy("rank") if spec.ranked else shown.orderBy(F.lower(F.col(key).cast("string")), key)
    order = sort_key(df, spec.sort)
    return shown.orderBy(order.desc() if spec.descending else order.asc(), key)


def filter_kind(df: DataFrame, column: str) -> str:
    """range for numbers; tick boxes for texts with few distinct values, else a text filter."""
    if dict(df.dtypes)[column] != "string":
        return "range"
    few = df.select(column).where(F.col(column) != "").distinct().limit(TICK_LIMIT + 1).count()
    return "tick" if few <= TICK_LIMIT else "text"


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The non-empty values of a column with their place in natural order, as (value, place)."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL AND value <> ''").distinct()
    return numbered(values, [natural_key(F.col("value")), F.col("value")])


def column_range(df: DataFrame, column: str) -> DataFrame:
    """The least and greatest value without missing ones; 0 and 1 if there is none."""
    x = F.col(column).cast("double")
    x = F.when(~F.isnan(x), x)
    return df.agg(F.coalesce(F.min(x), F.lit(0.0)).alias("low"), F.coalesce(F.max(x), F.lit(1.0)).alias("high"))


def ranked_base(ranked: DataFrame, catalog: DataFrame, key: str = "path") -> DataFrame:
    """A ranked list joined to the catalog: unknown paths drop out, the rank stays."""
    return ranked.join(catalog, key)


def repaired_order(order: list[int], n: int) -> list[int]:
    """A permutation of 0..n-1: repeated and unknown places go, missing ones follow."""
    kept = list(dict.fromkeys(k for k in order if 0 <= k < n))
    return kept + [k for k in range(n) if k not in set(kept)]


def reordered(df: DataFrame, order: list[int]) -> DataFrame:
    """Columns in a stored order, repaired."""
    return df.select(*(df.columns[k] for k in repaired_order(order, len(df.columns))))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """All rows of ``df`` with their place in the ascending ``order``, from 1; ``order`` ends in a unique column.

    Rows are range-sorted, so no task has all of them, and written to the shared folder: partitions that were computed
    anew could have other bounds. Only the number of rows of each partition comes to the driver. A page is ``row_range``.
    """
    spark = df.sparkSession
    keyed = df.withColumns({f"_k{k}": c for k, c in enumerate(order)})
    keys = [f"_k{k}" for k in range(len(order))]
    ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    ranged = ranged.drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = folder(spark, "numbered")
    ranged.write.mode("overwrite").parquet(at)
    ranged = spark.read.schema(ranged.schema).parquet(at)
    part = F.shiftright("_at", WITHIN_BITS).cast("int")
    starts, total = [], 0
    for p, n in sorted(ranged.groupBy(part.alias("_part")).count().collect()):
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    within = F.col("_at").bitwiseAND(F.lit((1 << WITHIN_BITS) - 1))
    out = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_start") + within + 1).select(*df.columns, name)


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "i") -> DataFrame:
    """All rows with their place, from 0, among the rows of their key; a key with a large share of the rows is spread over tasks."""
    placed = numbered(df, [*map(F.col, keys), *order], "_place")
    first = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return placed.join(first, keys).withColumn(name, F.col("_place") - F.col("_first")).select(*df.columns, name)


def row_range(df: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """The rows between two display rows (from 1, either way round), both included."""
    low, high = sorted((first, last))
    from pyspark.sql import Window

    return df.orderBy(*order).limit(high).withColumn("row", F.row_number().over(Window.orderBy(*order))).where(F.col("row") >= low)


def replace_selection(_: DataFrame, clicked: DataFrame) -> DataFrame:
    return clicked.distinct()


def extend_selection(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    return selected.union(clicked).distinct()


def toggle_selection(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """In one of both, not in both."""
    return selected.exceptAll(clicked).union(clicked.exceptAll(selected)).distinct()
