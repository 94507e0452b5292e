"""Filling panel values from records of the same series and scope (see chow_liu for the method).

Fields of the tree: the value's quantile bin within its series and scope, the bin carried from the last
two calendar months, the bin of the next two, the season, and the caller's categorical columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.months import month_index
from ..session import cut
from .chow_liu import fit_tree, posterior_modes

BINS = 8

# Figures that providers write for "no figure", and words of value_reason.
PLACEHOLDERS = (-999.0, -9999.0, -99999.0, -999999.0, -9999999.0, -99999999.0, -999999999.0, 999999.0, 9999999.0, 99999999.0, 999999999.0)
NO_ANSWER = ("", "-", "--", "?", ".", "..", "n/a", "na", "n.a.", "#n/a", "none", "null", "nil", "nan", "unknown", "tbd", "not applicable")
NOT_OBSERVED = r"missing|suppress|withheld|withhold|not[ _-]*(collected|observed|available|reported|recorded|measured|published)|no[ _-]*(data|observation|value)|unavailable|confidential|redacted|imputed|placeholder"


def reason_key(reason: Column) -> Column:
    """value_reason without case and outer blanks; '' for NULL."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(reason, r"[\s ]+", " "))), F.lit(""))


def says_nothing(reason: Column) -> Column:
    """True where value_reason is absent, blank or a mark for no answer."""
    return reason_key(reason).isin(*NO_ANSWER)


def how_written(value: Column, reason: Column) -> Column:
    """How a macro value is given: 0 usable, 1 absent, 2 not a number, 3 placeholder figure, 4 figure of a cell not observed."""
    return (
        F.when(value.isNull(), 1)
        .when(F.isnan(value), 2)
        .when(value.isin(*PLACEHOLDERS) | (F.abs(value) >= 1e19), 3)
        .when(reason_key(reason).rlike(NOT_OBSERVED), 4)
        .otherwise(0)
    )


def usable(value: Column, reason: Column) -> Column:
    """True where a macro cell holds an observed number."""
    return how_written(value, reason) == 0


def dictionary(df: DataFrame, column: str, size: int = 32) -> list[str]:
    """The states of a categorical column: its `size` most frequent values. Rarer ones share one more state in the
    tree; where that state is the most probable, a second lookup among the rare values decodes it."""
    top = df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(size).collect()
    return [r[0] for r in top]


def encode(column: Column, states: Sequence[str]) -> Column:
    """The state's number; len(states) for any other value, NULL for NULL."""
    code = F.when(column.isNull(), F.lit(None).cast("int"))
    for i, s in enumerate(states):
        code = code.when(column == s, i)
    return code.otherwise(len(states))


def fill_panel(
    panel: DataFrame, *, scope: str, entity: str, month: str, value: str, observed: str, fill: str,
    categories: dict[str, Sequence[str]] | None = None, targets: Sequence[str] = (), carry: str | None = None, reach: int = 2,
) -> DataFrame:
    """Fill `value` where the BOOLEAN column `fill` holds, from records of the same entity and scope.

    `observed` marks the figures to learn from, `carry` (default: observed) those that may be carried on.
    `categories` names string columns of the panel with their states; those in `targets` are filled too
    where NULL. Adds filled_as ('ffill' if one of the `reach` calendar months before holds an observation,
    else 'median'; NULL where nothing was filled), filled_value, filled_prob, filled_<target>, and filled_by,
    how the figure was truly made: the value is decoded from the posterior of its bin, to 'carried' (the
    carried observation, where it lies in the most probable bin) or 'bin_median'; an entity without any
    observation in the scope gets the median of its other scopes ('entity_median'), else that of the scope
    ('scope_median'); 'none' (no value) is left only where neither the entity nor the scope holds a figure.

    Repeated rows must have been removed. A window holds the months of one entity in one scope, which the
    calendar bounds; NULL keys form a group of their own and a malformed month has no months before it.
    """
    categories, carry = categories or {}, carry or observed
    by = [scope, entity]
    w = W.partitionBy(*by)
    in_time = w.orderBy("_mi")
    rank = F.rank().over(W.partitionBy(*by, F.col(observed)).orderBy(value))
    n = F.sum(F.col(observed).cast("int")).over(w)
    dated = F.col("_mi").isNotNull()
    coded = (
        panel.withColumn("_mi", month_index(F.col(month)))
        .withColumn("_bin", F.when(F.col(observed), F.least(F.floor((rank - 1) * BINS / n), F.lit(BINS - 1)).cast("int")))
        .withColumn("_held", F.when(F.col(carry), F.struct("_bin", F.col(value).alias("v"))))
        .withColumn("_before", F.when(dated, F.last("_held", True).over(in_time.rangeBetween(-reach, -1))))
        .withColumn("_next", F.when(dated, F.first(F.when(F.col(observed), F.col("_bin")), True).over(in_time.rangeBetween(1, reach))))
        .withColumns({"_lag": F.col("_before._bin"), "_carried": F.col("_before.v"), "_ahead": F.col("_next"), "_season": F.pmod("_mi", F.lit(12)).cast("int"), "_has_carry": F.col("_before").isNotNull()})
        .withColumns({f"_c_{c}": encode(F.col(c), s) for c, s in categories.items()})
        .drop("_held", "_before", "_next")
    )
    coded = cut(coded)  # read by the tree, the decoding and the output
    names = ["_bin", "_lag", "_ahead", "_season", *(f"_c_{c}" for c in categories)]
    cards = [BINS, BINS, BINS, 12, *(len(s) + 1 for s in categories.values())]
    tree = fit_tree(coded, names, cards)
    decoded = posterior_modes(coded.filter(F.col(fill)), tree, ["_bin", *(f"_c_{t}" for t in targets)])
    seen = coded.filter(F.col(observed))
    matched = lambda df, keys: df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in df.columns if c not in keys])

    def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        return left.join(matched(right, keys), on, "left").drop(*[f"_k_{k}" for k in keys])

    # the sorted observations of one entity in one scope: at most one a month
    decoded = attach(decoded, seen.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("_vals")), by)
    middle_of = lambda name: F.percentile_approx(value, 0.5, 10_000).alias(name)
    decoded = attach(decoded, seen.groupBy(entity).agg(middle_of("_of_entity")), [entity])
    decoded = attach(decoded, seen.groupBy(scope).agg(middle_of("_of_scope")), [scope])
    size = F.size("_vals")
    lo = F.floor(F.col("_bin_mode") * size / BINS)
    hi = F.greatest(F.floor((F.col("_bin_mode") + 1) * size / BINS) - 1, lo)
    middle = lambda x: F.get(F.col("_vals"), F.least(x, size - 1).cast("int"))
    median = (middle(F.floor((lo + hi) / 2)) + middle(F.ceil((lo + hi) / 2))) / 2
    made = (
        F.when((F.col("_lag") == F.col("_bin_mode")) & F.col("_carried").isNotNull(), "carried").when(F.col("_vals").isNotNull(), "bin_median")
        .when(F.col("_of_entity").isNotNull(), "entity_median").when(F.col("_of_scope").isNotNull(), "scope_median").otherwise("none")
    )
    figure = F.when(F.col("filled_by") == "carried", F.col("_carried")).when(F.col("filled_by") == "bin_median", median).otherwise(F.coalesce("_of_entity", "_of_scope"))
    decoded = decoded.withColumn("filled_by", made).withColumn("filled_value", figure)
    decoded = decoded.withColumns({"filled_as": F.when(F.col("_has_carry"), "ffill").otherwise("median"), "filled_prob": F.col("_bin_prob")})
    for t in targets:
        states = categories[t]
        rare = coded.filter(F.col(f"_c_{t}") == len(states)).groupBy(*by, t).count()
        best = lambda df, keys, name: df.groupBy(*keys).agg(F.max_by(t, F.struct("count", t)).alias(name))  # noqa: B023, E731
        lookups = []
        if states and not rare.isEmpty():
            decoded = attach(decoded, best(rare, by, "_rare1"), by)
            decoded = attach(decoded, best(rare.groupBy(entity, t).agg(F.sum("count").alias("count")), [entity], "_rare2"), [entity])
            (top,) = best(rare.groupBy(t).agg(F.sum("count").alias("count")), [], "x").first()
            lookups = [F.when(F.col(f"_c_{t}_mode") == len(states), F.coalesce("_rare1", "_rare2", F.lit(top)))]
        known = [F.lit(x) for x in states] or [F.lit(None).cast("string")]
        decoded = decoded.withColumn(f"filled_{t}", F.when(F.col(t).isNull(), F.coalesce(*lookups, F.get(F.array(*known), F.col(f"_c_{t}_mode")), known[0])))
    keep = panel.columns + ["filled_as", "filled_by", "filled_value", "filled_prob", *(f"filled_{t}" for t in targets)]
    rest = coded.filter(~F.coalesce(F.col(fill), F.lit(False)))
    return decoded.select(*keep).unionByName(rest.select(*panel.columns), allowMissingColumns=True)


def fill_macro(macro: DataFrame) -> DataFrame:
    """macro_vintage with missing values and reasons filled; repeated rows count once.

    Adds value_filled_as, filled_by (see fill_panel), filled_value, filled_prob and reason_filled_as ('reason'), filled_reason. An empty macro_group is not
    filled. Columns other than the table's own are ignored.
    """
    own = ["vintage_month", "base_month", "series", "value", "tcode", "macro_group", "assumed_available_at", "value_kind", "value_reason"]
    m = macro.select(*own).distinct()
    m = m.withColumns({
        "_how": how_written(F.col("value"), F.col("value_reason")),
        "_silent": says_nothing(F.col("value_reason")),
    })
    m = m.withColumns({
        "_obs": F.col("_how") == 0, "_gap": F.col("_how") != 0, "_mark": F.col("_how").cast("string"),
        # the tree learns from reasons stated for missing figures, so a filled reason explains a gap
        "why": F.when((F.col("_how") != 0) & ~F.col("_silent"), reason_key(F.col("value_reason"))),
    })
    reasons = macro.select(F.when((how_written(F.col("value"), F.col("value_reason")) != 0) & ~says_nothing(F.col("value_reason")), reason_key(F.col("value_reason"))).alias("why"))
    states = dictionary(reasons, "why")
    groups = [str(i) for i in range(1, 9)]
    m = m.withColumn("_group", F.col("macro_group").cast("string"))
    filled = fill_panel(
        m, scope="vintage_month", entity="series", month="base_month", value="value", observed="_obs", fill="_gap",
        categories={"why": states, "_mark": [str(i) for i in range(5)], "_group": groups}, targets=["why"],
    )
    return filled.select(
        *own, F.col("filled_as").alias("value_filled_as"), "filled_by", "filled_value", "filled_prob",
        F.when(F.col("_gap") & F.col("_silent"), "reason").alias("reason_filled_as"), F.when(F.col("_gap") & F.col("_silent"), F.col("filled_why")).alias("filled_reason"),
    )


def fill_features(features: DataFrame) -> DataFrame:
    """feature_result with empty cells and masks filled; repeated rows count once.

    A cell is empty where imputed is NULL or NaN; cells filled earlier are kept. Adds imputed_filled_as,
    filled_by (see fill_panel), filled_value, filled_prob and the masks after filling (filled_observed, filled_ffill, filled_median).
    """
    own = ["window_id", "decision_month", "base_month", "series", "imputed", "observed_mask", "ffill_mask", "median_mask"]
    f = features.select(*own).distinct()
    empty = F.col("imputed").isNull() | F.isnan("imputed")
    f = f.withColumns({"_gap": empty, "_obs": ~empty & F.coalesce(F.col("observed_mask"), F.lit(False)), "_true": F.coalesce(F.col("observed_mask"), F.lit(False))})
    f = f.withColumn("_mask", F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("ffill_mask", "median_mask")]))
    masks = [a + b for a in ("true", "false", "?") for b in ("true", "false", "?")]
    filled = fill_panel(f, scope="window_id", entity="series", month="base_month", value="imputed", observed="_obs", fill="_gap", carry="_true", categories={"_mask": masks})
    done = F.col("filled_as")
    return filled.select(
        *own, done.alias("imputed_filled_as"), "filled_by", "filled_value", "filled_prob",
        F.when(done.isNull(), F.col("observed_mask")).otherwise(False).alias("filled_observed"),
        F.when(done.isNull(), F.col("ffill_mask")).otherwise(done == "ffill").alias("filled_ffill"),
        F.when(done.isNull(), F.col("median_mask")).otherwise(done == "median").alias("filled_median"),
    )


def filled_cells(macro: DataFrame, features: DataFrame) -> DataFrame:
    """The cells that were filled and how: place, scope_key, base_month, series, field, filled_as."""
    m, f = fill_macro(macro), fill_features(features)
    macro_cells = m.filter("value_filled_as is not null").select(
        F.lit("macro_vintage").alias("place"), F.col("vintage_month").alias("scope_key"), "base_month", "series",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("value").alias("field"), F.col("value_filled_as").alias("filled_as")),
            F.when(F.col("reason_filled_as").isNotNull(), F.struct(F.lit("value_reason").alias("field"), F.col("reason_filled_as").alias("filled_as"))),
        ))).alias("c"),
    ).select("place", "scope_key", "base_month", "series", "c.field", "c.filled_as")
    feature_cells = f.filter("imputed_filled_as is not null").select(
        F.lit("feature_result").alias("place"), F.col("window_id").alias("scope_key"), "base_month", "series", F.lit("imputed").alias("field"), F.col("imputed_filled_as").alias("filled_as")
    )
    return macro_cells.unionByName(feature_cells)
