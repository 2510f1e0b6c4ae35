"""Running session state as window functions: the state after each event, never looking ahead.

A purchase settles the cart: it starts the next cycle before anything else of its row counts. All windows share
one shuffle by session; those of a cart cycle or a product only sort within it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CART, PURCHASE, REMOVE

#: Seconds of silence after which a session is over.
TIMEOUT = 1_800
MIN_EVENTS = 2
AT_RISK = 0.7
DAY, HOUR = 86_400, 3_600

# The 27 features, in order.
FEATURES = (
    "events", "views", "clicks", "searches", "cart_adds", "cart_removes", "cart_size", "cart_value", "log_cart_value",
    "distinct_products", "distinct_categories", "distinct_brands", "mean_price", "max_price", "log_max_price",
    "duration", "log_duration", "mean_gap", "max_gap", "events_per_minute", "view_ratio", "cart_add_ratio", "remove_ratio", "cart_to_view_ratio",
    "hour_of_day", "is_weekend", "is_mobile",
)

#: Columns of the state that features need, as windows and as the streaming fold give them.
STATE = (
    "user_id", "device", "first_ts", "last_ts", "events", "views", "clicks", "searches", "cart_adds", "cart_removes", "purchases", "open_adds", "cart_size", "cart_value",
    "products", "categories", "brands", "price_sum", "price_count", "price_max", "gap_sum", "gap_count", "gap_max",
)


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def session_state(events: DataFrame, seq: str = "event_id", session: str | Sequence[str] = "session_id", order: Sequence[str] = ()) -> DataFrame:
    """Every event with the state of its session after it: STATE, ``cycle``, ``gap``, ``event_index``.

    Events are ordered by time and then ``seq``, which must settle ties, or as ``order`` says; then late events may
    come after newer ones, and their gaps count as zero. The columns ``user_id`` and ``device`` become the session's
    first ones. ``session`` names the columns that set sessions apart.
    """
    key = [session] if isinstance(session, str) else list(session)
    order = list(order) or ["ts", seq]
    by = Window.partitionBy(*key).orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("event_type")
    n = lambda condition: F.coalesce(F.sum(F.when(condition, 1).otherwise(0)).over(so_far), F.lit(0))
    # greatest() skips nulls, so a session's first event must be left out by hand: it has no gap.
    step = F.col("ts") - F.lag("ts").over(by)
    gap = F.when(step.isNotNull(), F.greatest(F.lit(0), step))
    out = events.withColumns(
        {
            "gap": gap, "first_ts": F.first("ts").over(so_far), "last_ts": F.col("ts"), "event_index": F.row_number().over(by) - 1,
            "events": F.row_number().over(by), "views": n(kind == "view"), "clicks": n(kind == "click"), "searches": n(kind == "search"),
            "cart_adds": n(kind == CART), "cart_removes": n(kind == REMOVE), "purchases": n(kind == PURCHASE),
            "__user": F.first("user_id").over(so_far), "__device": F.first("device").over(so_far),
            "price_sum": F.coalesce(F.sum("price").over(so_far), F.lit(0.0)), "price_count": F.count("price").over(so_far),
            "price_max": F.greatest(F.lit(0.0), F.coalesce(F.max("price").over(so_far), F.lit(0.0))),
        }
    )
    out = out.withColumns({"gap_sum": F.coalesce(F.sum("gap").over(so_far), F.lit(0)), "gap_count": F.count("gap").over(so_far), "gap_max": F.coalesce(F.max("gap").over(so_far), F.lit(0)), "cycle": F.col("purchases")})
    # Distinct values so far: the first time that a value occurs counts one.
    for count, column in (("products", "product_id"), ("categories", "category"), ("brands", "brand")):
        first = (F.row_number().over(Window.partitionBy(*key, column).orderBy(*order)) == 1) & _present(column)
        out = out.withColumn("__first", first).withColumn(count, F.sum(F.col("__first").cast("int")).over(so_far))
    # The cart: the last price of each product in the cycle, as changes from what the product had before.
    product = _present("product_id")
    change = F.when(product & (kind == CART) & F.col("price").isNotNull(), F.col("price")).when(product & (kind == REMOVE), 0.0)
    inside = F.when(product & (kind == CART) & F.col("price").isNotNull(), 1).when(product & (kind == REMOVE), 0)
    before = Window.partitionBy(*key, "cycle", "product_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cycle = Window.partitionBy(*key, "cycle").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"__v": change, "__i": inside})
    out = out.withColumns({"__dv": F.col("__v") - F.coalesce(F.last("__v", True).over(before), F.lit(0.0)), "__di": F.col("__i") - F.coalesce(F.last("__i", True).over(before), F.lit(0))})
    out = out.withColumns(
        {
            "cart_value": F.coalesce(F.sum("__dv").over(cycle), F.lit(0.0)), "cart_size": F.coalesce(F.sum("__di").over(cycle), F.lit(0)),
            "open_adds": F.sum(F.when(product & (kind == CART), 1).otherwise(0)).over(cycle),
            "user_id": F.col("__user"), "device": F.col("__device"),
        }
    )
    return out.drop("__user", "__device", "__first", "__v", "__i", "__dv", "__di")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def features() -> dict[str, Column]:
    """The 27 features from STATE columns: the one definition that batch and streaming share.

    The day of the week is counted so that the last two of its days, Friday and Saturday, are the weekend.
    """
    c, real = F.col, lambda x: F.col(x).cast("double")
    duration = c("last_ts") - c("first_ts")
    out = {
        "cart_value": real("cart_value"), "log_cart_value": F.log1p("cart_value"), "distinct_products": real("products"), "distinct_categories": real("categories"), "distinct_brands": real("brands"),
        "mean_price": ratio(c("price_sum"), c("price_count")), "max_price": real("price_max"), "log_max_price": F.log1p("price_max"),
        "duration": duration.cast("double"), "log_duration": F.log1p(duration), "mean_gap": ratio(c("gap_sum"), c("gap_count")), "max_gap": real("gap_max"),
        "events_per_minute": ratio(c("events") * 60.0, duration), "view_ratio": ratio(c("views"), c("events")), "cart_add_ratio": ratio(c("cart_adds"), c("events")),
        "remove_ratio": ratio(c("cart_removes"), F.greatest("cart_adds", F.lit(1))), "cart_to_view_ratio": ratio(c("cart_adds"), F.greatest("views", F.lit(1))),
        "hour_of_day": F.pmod("last_ts", F.lit(DAY)) / HOUR,
        "is_weekend": (F.pmod(F.floor(c("last_ts") / DAY) + 4, F.lit(7)) >= 5).cast("double"),
        "is_mobile": F.coalesce((F.lower("device") == "mobile").cast("double"), F.lit(0.0)),
    }
    return {f: out.get(f, real(f) if f not in out else None) for f in FEATURES}


def feature_rows(state: DataFrame, keep: tuple[str, ...] = ("session_id", "event_index")) -> DataFrame:
    return state.select(*keep, *[v.cast("double").alias(k) for k, v in features().items()])


def open_cart(state: DataFrame) -> DataFrame:
    """Rows whose session has a cart that can still be abandoned."""
    return state.filter(F.col("open_adds") > 0)


def scoring_gate() -> Column:
    """Null where an event is scored, else why not."""
    return F.when(F.col("open_adds") <= 0, "no open cart").when(F.col("events") < MIN_EVENTS, "fewer than two events")


def with_runs(events: DataFrame, timeout: int = TIMEOUT, session: str = "session_id", order: Sequence[str] = ("offset",), name: str = "run") -> DataFrame:
    """``events`` with the number (from 0) of their session's run: a pause of more than ``timeout`` starts the next one."""
    by = Window.partitionBy(session).orderBy(*order)
    pause = F.col("ts") - F.lag("ts").over(by) > timeout
    return events.withColumn(name, F.sum(F.when(pause, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def running_watermarks(events: DataFrame, partition: str = "partition", order: Sequence[str] = ("offset",)) -> DataFrame:
    """``events`` with ``watermark``, the newest time that their own partition had shown by then.

    A log partition is one writer's order, so it is also one task here.
    """
    return events.withColumn("watermark", F.max("ts").over(Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def watermarks(events: DataFrame, partition: str = "partition") -> DataFrame:
    """(partition, watermark): the newest event of each partition, never of all."""
    return events.groupBy(partition).agg(F.max("ts").alias("watermark"))


def expired_sessions(events: DataFrame, partition: str = "partition", session: str = "session_id", timeout: int = TIMEOUT) -> DataFrame:
    """(session, last_ts, watermark) of sessions that went quiet, by their own partition's progress."""
    last = events.groupBy(partition, session).agg(F.max("ts").alias("last_ts"))
    return last.join(watermarks(events, partition), partition).filter(F.col("watermark") - F.col("last_ts") > timeout).select(session, "last_ts", "watermark")


def partition_of(column: str, partitions: int = 12) -> Column:
    """The log partition of a key: equal keys, equal partitions."""
    return F.pmod(F.xxhash64(column), F.lit(partitions)).cast("int")
