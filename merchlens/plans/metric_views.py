"""Business metrics over related tables, by name.

A view names tables, many-to-one references between them, metrics and synonyms. A query groups each metric
at its own table, brings in parent columns only as far as asked, and stacks the results, so two child
tables of one parent never multiply each other's rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from merchlens.session import settled

#: Rows of a table that one task groups, where groups are as fine as references.
TASK_ROWS = 1 << 18


@dataclass(frozen=True)
class Metric:
    """``kind`` (sum, avg, min, max or distinct) of a SQL expression over one table, times ``scale``."""

    table: str
    kind: str
    value: str
    scale: float | None = None


@dataclass(frozen=True)
class Ref:
    child: str
    column: str
    parent: str
    parent_column: str


_PARTIAL = {
    "sum": lambda n, v: [F.sum(v).alias(n)],
    "min": lambda n, v: [F.min(v).alias(n)],
    "max": lambda n, v: [F.max(v).alias(n)],
    "avg": lambda n, v: [F.sum(v).alias(n), F.count(v).alias(f"{n}__n")],
}
_FINAL = {
    "sum": lambda n: F.sum(n),
    "min": lambda n: F.min(n),
    "max": lambda n: F.max(n),
    "avg": lambda n: F.sum(n) / F.sum(f"{n}__n"),
}


@dataclass(frozen=True)
class _Picked:
    """Rows of a table, its key columns, the dims shown, the way to other tables, and tests to make there."""

    rows: DataFrame
    table: str
    keys: list[str]
    shown: list[str]
    steps: list[Ref]
    wanted: dict[str, list[str]]
    later: dict[str, tuple[str, Callable[[Column], Column]]]


@dataclass(frozen=True)
class MetricView:
    tables: Mapping[str, DataFrame]
    refs: Sequence[Ref]
    metrics: Mapping[str, Metric]
    synonyms: Mapping[str, tuple[str, ...]]

    def resolve(self, name: str) -> str:
        """The metric or ``table.column`` a name or synonym stands for."""
        low = name.strip().lower()
        if low in self.metrics or ("." in low and low.split(".")[0] in self.tables):
            return low
        hits = [target for target, words in self.synonyms.items() if low in words]
        hits += [f"{t}.{low}" for t, df in self.tables.items() if low in df.columns]
        if not hits:
            raise KeyError(f"unknown name: {name}")
        if len(hits) > 1:
            warnings.warn(f"{name!r} may mean {hits}; using {hits[0]}", stacklevel=2)
        return hits[0]

    def _path(self, start: str, goal: str) -> list[Ref]:
        """References from a table up to a parent; raises when there is no way."""
        trails = [(start, [])]
        while trails:
            at, trail = trails.pop(0)
            if at == goal:
                return trail
            trails += [(r.parent, [*trail, r]) for r in self.refs if r.child == at and r not in trail]
        raise ValueError(f"{goal} cannot be reached from {start}")

    def _picked(self, table: str, names: Sequence[str], dims: Mapping[str, str], where) -> _Picked:
        """The rows of one table with what its metrics and dims need."""
        shown = {alias: d.split(".") for alias, d in dims.items()}
        tested = {f"__w{i}": d.split(".") for i, d in enumerate(where)}
        wanted = {**shown, **tested}
        steps: list[Ref] = []
        for t, _ in wanted.values():
            steps += [r for r in self._path(table, t) if r not in steps]
        base = self.tables[table]
        for t, c in tested.values():
            if t == table:
                base = base.filter(where[f"{t}.{c}"](F.col(c)))
        keys = {f"__fk_{r.column}": F.col(r.column) for r in steps if r.child == table}
        keys |= {alias: F.col(c) for alias, (t, c) in shown.items() if t == table}
        values = [F.expr(self.metrics[n].value).alias(f"__m_{n}") for n in names]
        rows = base.select(*[c.alias(a) for a, c in keys.items()], *values)
        later = {alias: (f"{t}.{c}", where[f"{t}.{c}"]) for alias, (t, c) in tested.items() if t != table}
        return _Picked(rows, table, list(keys), list(shown), steps, wanted, later)

    def _joined(self, rows: DataFrame, picked: _Picked) -> DataFrame:
        """Rows with a table's keys, followed to the parents that dims and tests stand in."""
        for step in picked.steps:
            parent = self.tables[step.parent]
            link = f"__fk_{step.column}" if step.child == picked.table else f"__fk_{step.child}_{step.column}"
            cols = [F.col(step.parent_column).alias("__pk")]
            cols += [F.col(c).alias(a) for a, (t, c) in picked.wanted.items() if t == step.parent]
            cols += [F.col(r.column).alias(f"__fk_{r.child}_{r.column}") for r in picked.steps if r.child == step.parent]
            rows = rows.join(parent.select(*cols), F.col(link) == F.col("__pk"), "left").drop("__pk", link)
        for alias, (_, test) in picked.later.items():
            rows = rows.filter(test(F.col(alias)))
        return rows

    def _frame(self, table: str, names: Sequence[str], dims: Mapping[str, str], where) -> DataFrame:
        """The metrics of one table grouped by the dims.

        Before any join there is one row per reference, so a hot parent is one row too. A distinct metric that needs
        other tables comes alone and keeps one row per reference and value: a value may stand with several references
        of one group, so its counts don't add up. Where the dims show every reference, groups are as fine as references:
        the rows are written, joined as they are and grouped once, over as many tasks as their number asks for.
        """
        picked = self._picked(table, names, dims, where)
        specs = {n: self.metrics[n] for n in names}
        rows, out = picked.rows, []
        adds = bool(picked.steps) and all(m.kind != "distinct" for m in specs.values())
        fine = adds and {r.column for r in picked.steps if r.child == table} <= {c for t, c in map(picked.wanted.get, picked.shown) if t == table}
        if fine:
            rows = settled(rows, "view-rows")
            tasks = -(-rows.count() // TASK_ROWS) or 1
            rows, adds = self._joined(rows, picked).repartition(tasks, *picked.shown), False
        elif adds:
            partial = [c for n, m in specs.items() for c in _PARTIAL[m.kind](f"__m_{n}", F.col(f"__m_{n}"))]
            rows = self._joined(rows.groupBy(*picked.keys).agg(*partial), picked)
        elif picked.steps:
            rows = self._joined(rows.distinct(), picked)
        for n, m in specs.items():
            if adds:
                value = _FINAL[m.kind](f"__m_{n}")
            else:
                agg = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "distinct": F.count_distinct}[m.kind]
                value = agg(F.col(f"__m_{n}"))
            out.append((value if m.scale is None else value * m.scale).alias(n))
        return rows.groupBy(*picked.shown).agg(*out)

    def query(
        self,
        metrics: Sequence[str],
        dims: Sequence[str] | Mapping[str, str] = (),
        where: Mapping[str, Callable[[Column], Column]] | None = None,
        order: Sequence[Column] | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        """Metrics by dimensions. ``dims`` are names or {alias: name}; ``where`` maps names to tests."""
        named = {m: self.resolve(m) for m in metrics}
        unknown = [m for m, r in named.items() if r not in self.metrics]
        if unknown:
            raise KeyError(f"not a metric: {unknown}")
        if not isinstance(dims, Mapping):
            dims = {self.resolve(d).split(".")[1]: d for d in dims}
        dims = {alias: self.resolve(d) for alias, d in dims.items()}
        where = {self.resolve(d): test for d, test in (where or {}).items()}
        names = list(dict.fromkeys(named.values()))
        by_table: dict[tuple[str, str], list[str]] = {}
        for n in names:
            m = self.metrics[n]
            joined = any(d.split(".")[0] != m.table for d in (*dims.values(), *where))
            by_table.setdefault((m.table, n if joined and m.kind == "distinct" else ""), []).append(n)
        frames = [self._frame(t, ns, dims, where) for (t, _), ns in by_table.items()]
        out = frames[0]
        if len(frames) > 1:
            stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
            out = stacked.groupBy(*dims).agg(*[F.max(n).alias(n) for n in names])
        out = out.select(*dims, *names)
        if order:
            out = out.orderBy(*order)
        return out if limit is None else out.limit(limit)

    def compare(self, metric: str, time: str, anchor: str, dims: Sequence[str] = (), days: int = 30) -> DataFrame:
        """A metric in the ``days`` up to ``anchor`` and in as many days before, with change and share."""
        name = self.resolve(metric)
        table, column = self.resolve(time).split(".")
        if table != self.metrics[name].table:
            raise ValueError("compare needs a time column of the metric's own table")
        end = F.lit(anchor).cast("timestamp_ntz")
        at = F.col(column).cast("timestamp_ntz")
        mid, start = end - F.expr(f"INTERVAL {days} DAYS"), end - F.expr(f"INTERVAL {2 * days} DAYS")
        marked = self.tables[table].filter((at > start) & (at <= end)).withColumn(
            "__period", F.when(at > mid, "current").otherwise("previous")
        )
        view = replace(self, tables={**self.tables, table: marked})
        shown = {self.resolve(d).split(".")[1]: d for d in dims}
        split = view.query([name], {**shown, "__period": f"{table}.__period"})
        current, previous = (F.max(F.when(F.col("__period") == p, F.col(name))).alias(p) for p in ("current", "previous"))
        both = split.groupBy(*shown).agg(current, previous)
        delta = F.coalesce("current", F.lit(0)) - F.coalesce("previous", F.lit(0))
        return both.select(*shown, "current", "previous", delta.alias("delta"), F.try_divide(delta, "previous").alias("pct"))


def product_view(products: DataFrame, variants: DataFrame, price_history: DataFrame, promotions: DataFrame) -> MetricView:
    return MetricView(
        {"price_hist": price_history, "product": products, "promo": promotions, "variant": variants},
        [Ref("price_hist", "product_id", "product", "product_id"), Ref("variant", "product_id", "product", "product_id")],
        {
            "avg_price": Metric("product", "avg", "current_price"),
            "max_price": Metric("product", "max", "current_price"),
            "min_price": Metric("product", "min", "current_price"),
            "product_count": Metric("product", "distinct", "product_id"),
            "active_promos": Metric("promo", "distinct", "CASE WHEN is_active THEN promotion_id END"),
            "variant_count": Metric("variant", "distinct", "variant_id"),
        },
        PRODUCT_WORDS,
    )


def social_view(
    reviews: DataFrame, mentions: DataFrame, influencers: DataFrame, trending: DataFrame, products: DataFrame
) -> MetricView:
    return MetricView(
        {"influencer": influencers, "mention": mentions, "product": products, "review": reviews, "trending": trending},
        [Ref(t, "product_id", "product", "product_id") for t in ("influencer", "mention", "review", "trending")],
        {
            "influencer_mention_count": Metric("influencer", "distinct", "mention_id"),
            "mention_count": Metric("mention", "distinct", "mention_id"),
            "total_engagement": Metric("mention", "sum", "likes + comments + shares"),
            "avg_rating": Metric("review", "avg", "rating"),
            "review_count": Metric("review", "distinct", "review_id"),
            "viral_product_count": Metric("trending", "distinct", "CASE WHEN is_viral THEN product_id END"),
        },
        SOCIAL_WORDS,
    )


def cart_view(
    sessions: DataFrame, items: DataFrame, orders: DataFrame, order_items: DataFrame, fulfillment: DataFrame, products: DataFrame
) -> MetricView:
    return MetricView(
        {
            "session": sessions, "item": items, "order_tbl": orders, "order_item": order_items,
            "fulfillment": fulfillment, "product": products,
        },
        [
            Ref("item", "product_id", "product", "product_id"),
            Ref("item", "session_id", "session", "session_id"),
            Ref("order_tbl", "session_id", "session", "session_id"),
            Ref("order_item", "order_id", "order_tbl", "order_id"),
            Ref("order_item", "product_id", "product", "product_id"),
        ],
        {
            "cart_count": Metric("session", "distinct", "session_id"),
            "completed_cart_count": Metric("session", "distinct", "CASE WHEN status = 'completed' THEN session_id END"),
            "avg_cart_value": Metric("session", "avg", "total_cents", 0.01),
            "total_items": Metric("item", "sum", "quantity"),
            "order_count": Metric("order_tbl", "distinct", "order_id"),
            "total_revenue": Metric("order_tbl", "sum", "total_cents", 0.01),
        },
        CART_WORDS,
    )


def customer_view(customers: DataFrame, analyses: DataFrame) -> MetricView:
    return MetricView(
        {"customer": customers, "analysis": analyses},
        [Ref("analysis", "customer_id", "customer", "customer_id")],
        {
            "customer_count": Metric("customer", "distinct", "customer_id"),
            "avg_points": Metric("customer", "avg", "points_balance"),
            "total_points": Metric("customer", "sum", "points_balance"),
            "analysis_count": Metric("analysis", "distinct", "analysis_id"),
        },
        CUSTOMER_WORDS,
    )


def inventory_view(locations: DataFrame, stock: DataFrame, products: DataFrame) -> MetricView:
    return MetricView(
        {"location": locations, "stock": stock, "product": products},
        [Ref("stock", "location_id", "location", "location_id"), Ref("stock", "product_id", "product", "product_id")],
        {
            "location_count": Metric("location", "distinct", "location_id"),
            "total_on_hand": Metric("stock", "sum", "quantity_on_hand"),
            "total_reserved": Metric("stock", "sum", "quantity_reserved"),
            "total_available": Metric("stock", "sum", "quantity_on_hand - quantity_reserved"),
            "low_stock_count": Metric("stock", "distinct", "CASE WHEN quantity_on_hand <= reorder_point THEN stock_id END"),
        },
        INVENTORY_WORDS,
    )


# Other words for metrics and columns, per view.
PRODUCT_WORDS = {
    "product.base_price": ("msrp", "original price", "regular price"),
    "product.current_price": ("cost", "price", "sale price"),
    "promo.discount_value": ("discount", "off", "savings"),
    "product.brand": ("brand name", "company", "manufacturer"),
    "product.category": ("product category", "product type", "type"),
    "product.color_name": ("color", "shade", "shade name"),
    "product.finish": ("formula", "texture"),
    "product.is_active": ("available", "in stock"),
    "product.name": ("product", "product name", "title"),
    "product.skin_tone_compatibility": ("compatible skin tones", "skin tone", "skin tone match"),
    "product.skin_type_compatibility": (
        "combination skin", "dry skin", "normal skin", "oily skin", "sensitive skin", "skin type",
    ),
    "product.undertone_compatibility": (
        "cool undertone", "neutral undertone", "skin undertone", "undertone", "undertones", "warm undertone",
    ),
    "promo.name": ("deal name", "offer name", "promo name", "sale name"),
    "promo.promo_code": ("code", "coupon code", "discount code"),
    "avg_price": ("average price",),
    "max_price": ("highest price", "most expensive"),
    "min_price": ("cheapest", "lowest price"),
}
SOCIAL_WORDS = {
    "review.rating": ("review rating", "score", "stars"),
    "influencer.influencer_handle": ("blogger", "creator", "influencer"),
    "influencer.is_sponsored": ("ad", "paid", "partnership", "sponsored"),
    "mention.author_handle": ("author", "handle", "poster", "username"),
    "mention.platform": ("channel", "social network"),
    "mention.sentiment_label": ("mood", "sentiment", "tone"),
    "product.category": ("product category", "product type"),
    "product.name": ("product name",),
    "review.review_text": ("comment", "feedback text", "review"),
    "avg_rating": ("average rating", "average stars"),
}
CART_WORDS = {
    "session.subtotal_cents": ("subtotal", "items total", "cart subtotal"),
    "session.discount_cents": ("discount", "savings"),
    "session.total_cents": ("total", "grand total", "cart total"),
    "item.quantity": ("qty", "count"),
    "session.status": ("cart status", "checkout status"),
    "session.fulfillment_type": ("delivery type", "shipping type"),
    "order_tbl.order_number": ("order number", "confirmation number"),
    "order_tbl.status": ("order status", "order state"),
    "fulfillment.name": ("shipping option", "shipping method", "delivery method"),
    "product.category": ("product category", "product type"),
    "product.name": ("product name",),
    "avg_cart_value": ("average order value", "aov"),
    "total_revenue": ("revenue", "sales"),
}
CUSTOMER_WORDS = {
    "customer.points_balance": ("loyalty points", "rewards points", "points"),
    "customer.loyalty_tier": ("tier", "membership level", "status"),
    "analysis.skin_hex": ("skin tone", "skin shade", "complexion", "skin color"),
    "analysis.undertone": ("skin undertone", "warm", "cool", "neutral"),
    "analysis.fitzpatrick_type": ("fitzpatrick scale", "fitzpatrick", "skin type number"),
    "analysis.monk_shade": ("monk skin tone", "monk scale", "mst"),
}
INVENTORY_WORDS = {
    "stock.quantity_on_hand": ("on hand", "available", "in stock", "qty"),
    "stock.quantity_reserved": ("reserved", "held", "allocated"),
    "location.name": ("store name", "warehouse name", "location name"),
    "location.location_type": ("type",),
    "location.postal_code": ("zip", "zip code"),
    "location.is_pickup_enabled": ("bopis", "buy online pickup in store", "curbside", "pickup available"),
    "product.category": ("product category", "product type"),
    "product.name": ("product name",),
    "total_available": ("available inventory", "sellable inventory"),
}
