"""Training and scoring from contacts, items and the roles of their columns."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salescast.functions.columns import crossed, day_of, fold_of, refuse, smoothed, summable
from salescast.operators.asof import carried
from salescast.operators.encode import (
    encoding_columns,
    encodings_from_counts,
    fold_columns,
    label_means,
    likelihood_apply,
    roll_up,
    total,
)
from salescast.operators.evaluate import accuracy, forecast
from salescast.operators.features import (
    attach_items,
    daily_sums,
    history_apply,
    history_join,
    history_names,
    history_table,
    history_totals,
    price_vs_peers,
    prices_at,
    refuse_repeated,
)
from salescast.operators.fill import nb_fill
from salescast.operators.joins import fits_broadcast, lookup_join
from salescast.operators.layers import (
    feature_importance,
    fit_amount_layer,
    fit_buy_layer,
    score_two_layer,
)
from salescast.sources.staging import stage

NO_VALUE = -1.0  # stands for NULL in the trees
FEATURE = "x_"  # columns of features; those of the rows stay as they are


@dataclass(frozen=True)
class Roles:
    """Which columns play which part. ``item`` has one name in contacts and items, and is
    the only name they share; ``row_id`` is unique among the contacts.

    ``gaps`` maps a column of the items to the attributes it is filled from, and
    ``widths`` gives the interval of a numeric one. ``nominal`` lists the columns, or
    crossed columns, to encode by the buy label; ``amount_nominal`` those to encode by the
    amount that buyers took, which only the second layer sees; ``numeric`` those used as
    they are. ``offer`` is the price a contact saw, where contacts have one of their own.
    """

    row_id: str
    user: str
    item: str
    ts: str
    buy: str
    amount: str
    price: str
    origin: str
    peers: str
    gaps: dict[str, list[str]] = field(default_factory=dict)
    widths: dict[str, float] = field(default_factory=dict)
    nominal: list[list[str]] = field(default_factory=list)
    amount_nominal: list[list[str]] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    offer: str | None = None
    m: float = 20.0
    n_folds: int = 5


@dataclass(frozen=True, eq=False)
class Target:
    """What is encoded by: the letter behind the sums, the label, the keys."""

    tag: str
    label: Column
    nominal: list[list[str]]

    def name(self, keys: list[str]) -> str:
        return _encoded(keys, "amount_likelihood_" if self.tag else "likelihood_")


def _targets(roles: Roles) -> list[Target]:
    bought = F.when(F.col(roles.buy) == 1, F.col(roles.amount))
    targets = [Target("", F.col(roles.buy), roles.nominal), Target("a", bought, roles.amount_nominal)]
    return targets[: 2 if roles.amount_nominal else 1]


def _encoded(keys: list[str], prefix: str = "likelihood_") -> str:
    """Name of an encoding, two underlines between its columns."""
    return prefix + "__".join(keys)


def _encodings(roles: Roles) -> dict[str, list[str]]:
    """Names and keys of all encodings."""
    return {t.name(keys): keys for t in _targets(roles) for keys in t.nominal}


def _fold_columns(roles: Roles) -> list[Column]:
    """Counts and sums by fold, of all targets."""
    columns = []
    for t in _targets(roles):
        made = fold_columns(t.label, "_fold", roles.n_folds, t.tag, exact=bool(t.tag))
        columns += made[1:] if columns else made
    return columns


def _sides(roles: Roles) -> dict[str, str]:
    return {"user": roles.user, "item": roles.item}


def _measures(roles: Roles, side: str) -> dict[str, Column]:
    measures = {
        "buys": F.coalesce(F.col(roles.buy).cast("long"), F.lit(0)),
        "qty": F.coalesce(summable(F.col(roles.amount)), F.lit(0)),
    }
    if side == "item" and roles.offer:
        offer = summable(F.col(roles.offer))
        measures |= {"offer": offer, "offers": offer.isNotNull().cast("long")}
    return measures


def feature_columns(roles: Roles, layer: str = "buy") -> list[str]:
    """Columns of the features of a layer, in the order of ``feature_names``."""
    return [FEATURE + name for name in feature_names(roles, layer)]


def feature_names(roles: Roles, layer: str = "buy") -> list[str]:
    """What a layer sees. A numeric column has a second feature, whether it is there."""
    past = ("contacts_before", "buys_before", "qty_before", "days_since")
    return [
        "day_of_week",
        roles.price,
        "price_ratio",
        "price_rank",
        *[f"{side}_{name}" for side in ("user", "item") for name in past],
        *[_encoded(keys) for keys in roles.nominal],
        *roles.numeric,
        *[f"{name}_is_null" for name in roles.numeric],
        *([roles.offer, "offer_vs_list", "offer_vs_past"] if roles.offer else []),
        *(["offer_last", "offer_vs_last", "offer_last_days"] if roles.offer else []),
        *([t.name(keys) for t in _targets(roles)[1:] for keys in t.nominal] if layer == "amount" else []),
    ]


def prepare_items(items: DataFrame, roles: Roles) -> DataFrame:
    """Fill the gaps of the items and compare each price with its peers'."""
    refuse_repeated(items, roles.item)
    filled = nb_fill(items, roles.gaps, widths=roles.widths) if roles.gaps else items
    return stage(price_vs_peers(filled, roles.peers, roles.price, [roles.item]))


@dataclass
class Forecaster:
    """Fitted statistics and layers; nothing in it comes from the rows to be scored.

    ``items`` carry the encodings of their attributes, ``totals`` the encodings of user
    and item, ``encodings`` the other ones. ``defaults`` are the encodings of rows that
    match none of them.
    """

    roles: Roles
    items: DataFrame
    totals: dict[str, DataFrame]
    encodings: dict[str, DataFrame]
    defaults: dict[str, float]
    buy_layer: GBTClassificationModel | None = None
    amount_layer: GBTRegressionModel | None = None

    def features(self, rows: DataFrame) -> DataFrame:
        """Features of rows later than the training rows."""
        return _finished(self._wide(rows), self.roles, rows.columns)

    def _wide(self, rows: DataFrame) -> DataFrame:
        """The rows with all that is looked up for them."""
        roles, row_id = self.roles, [self.roles.row_id]
        _check_names(rows, roles)
        wide = attach_items(rows, self.items, roles.item, row_id, unique=True)
        for side, key in _sides(roles).items():
            wide = history_apply(
                wide, self.totals[side], key, roles.ts, _measures(roles, side), side, row_id
            )
        if roles.offer:
            day = day_of(roles.ts)
            wide = wide.withColumns({
                "item_offer_last": F.when(day.isNotNull(), F.col("item_offer_last")),
                "item_offer_last_days": F.date_diff(day, F.col("item_offer_last_day")),
            })
        for name, keys in _encodings(roles).items():
            default = F.lit(self.defaults[name])
            if name in self.encodings:
                wide = likelihood_apply(
                    wide, self.encodings[name], keys, default, name, row_id
                )
            else:
                wide = wide.withColumn(name, F.coalesce(F.col(name), default))
        return wide

    def score_at(self, rows: DataFrame, factors: list[float], threshold: float = 0.5) -> DataFrame:
        """``score`` at several multiples of the price, with ``price_factor``; factor 1 gives what ``score`` gives.

        It is the price of the contact that changes where contacts have one, and else the
        item's listed price, among peers whose prices stay. What follows from the price is
        computed again, all other features stay. Rows are looked up once, and repeated after that.
        ``factors`` are few.
        """
        roles, wide = self.roles, self._wide(rows)
        refuse(wide, ["price_factor", "_price", "_ratio", "_rank"], "score_at")
        if not factors or len(set(factors)) < len(factors) or min(factors) <= 0:
            raise ValueError("different factors above 0")
        steps = F.array(*[F.lit(float(f)) for f in factors])
        if not roles.offer:
            listed = self.items.select(roles.item, roles.peers, roles.price)
            names = {"price": "_price", "price_ratio": "_ratio", "price_rank": "_rank"}
            at = prices_at(listed.withColumnsRenamed({roles.item: "_row_of"}), "_row_of", roles.peers, roles.price, factors)
            at = stage(at.withColumnsRenamed({"_row_of": roles.item, **names}).drop("peer_price"))
        wide = wide.withColumn("price_factor", F.explode(steps))
        if roles.offer:
            changed = F.col(roles.offer).cast("double") * F.col("price_factor")
            wide = wide.withColumn(roles.offer, F.when(F.col("price_factor") == 1, F.col(roles.offer).cast("double")).otherwise(changed))
        else:
            wide = lookup_join(wide, at, [roles.item, "price_factor"], row_id=[roles.row_id])
            wide = wide.withColumns({roles.price: F.col("_price"), "price_ratio": F.col("_ratio"), "price_rank": F.col("_rank")})
        ready = _finished(wide, roles, [*rows.columns, "price_factor"])
        seen = feature_columns(roles), feature_columns(roles, "amount")
        return score_two_layer(ready, self.buy_layer, self.amount_layer, seen[0], threshold, seen[1])

    def forecast_at(self, rows: DataFrame, factors: list[float], keys: list[str]) -> DataFrame:
        """Expected quantity and revenue (``forecast``) per key and ``price_factor``."""
        price = self.roles.offer or self.roles.price
        return forecast(self.score_at(rows, factors), [*keys, "price_factor"], price=price)

    def score(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Rows, features and ``p_buy, buy_predicted, amount_predicted, qty_gated, qty_expected``.

        The columns of the rows stay as they are, labels included, and the price of the
        item comes with them, NULL for an item that is not listed.
        """
        return score_two_layer(
            self.features(rows),
            self.buy_layer,
            self.amount_layer,
            feature_columns(self.roles),
            threshold,
            feature_columns(self.roles, "amount"),
        )

    def evaluate(self, rows: DataFrame) -> DataFrame:
        """Accuracy of the first layer on later rows that do have the label."""
        return accuracy(self.score(rows), self.roles.buy, "buy_predicted")

    def importance(self, layer: str) -> DataFrame:
        model = {"buy": self.buy_layer, "amount": self.amount_layer}[layer]
        return feature_importance(model, feature_names(self.roles, layer)).select(
            F.lit(layer).alias("layer"), "feature", "importance", "rank"
        )

    def save(self, path: str) -> None:
        spark = self.items.sparkSession
        self.items.write.parquet(f"{path}/items")
        for kind, tables in (("totals", self.totals), ("encodings", self.encodings)):
            for name, table in tables.items():
                table.write.parquet(f"{path}/{kind}/{name}")
        self.buy_layer.write().save(f"{path}/buy_layer")
        self.amount_layer.write().save(f"{path}/amount_layer")
        about = json.dumps(
            {
                "roles": asdict(self.roles),
                "defaults": self.defaults,
                "encodings": list(self.encodings),
            }
        )
        # last, so that a folder with it is whole
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forecaster:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        roles = Roles(**about["roles"])
        return cls(
            roles=roles,
            items=spark.read.parquet(f"{path}/items"),
            totals={s: spark.read.parquet(f"{path}/totals/{s}") for s in ("user", "item")},
            encodings={
                name: spark.read.parquet(f"{path}/encodings/{name}")
                for name in about["encodings"]
            },
            defaults=about["defaults"],
            buy_layer=GBTClassificationModel.load(f"{path}/buy_layer"),
            amount_layer=GBTRegressionModel.load(f"{path}/amount_layer"),
        )


def _check_names(rows: DataFrame, roles: Roles) -> None:
    """Columns of the rows must not be named as what is added on the way, encodings as each other."""
    if len(_encodings(roles)) < len(roles.nominal) + len(roles.amount_nominal):
        raise ValueError("two encodings have the same name")
    added = [f"{side}_{name}" for side in _sides(roles) for name in ("days_since",)]
    for side in _sides(roles):
        added += history_names(_measures(roles, side), side)
    added += [*_encodings(roles), *feature_columns(roles, "amount")]
    added += ["item_offer_last", "item_offer_last_days", "item_offer_last_day"] if roles.offer else []
    added += ["peer_price", "price_ratio", "price_rank", "_day", "_fold", "_last", "_value"]
    refuse(rows, added, "the forecaster")


def _finished(wide: DataFrame, roles: Roles, keep: list[str]) -> DataFrame:
    """The given columns and the item's price as they are, and the features without NULL."""
    price = [] if roles.price in keep else [roles.price]
    made = {"day_of_week": F.dayofweek(day_of(roles.ts))}
    made |= {f"{name}_is_null": F.col(name).isNull().cast("int") for name in roles.numeric}
    if roles.offer:
        offer = F.col(roles.offer).cast("double")
        past = F.try_divide(F.col("item_offer_before").cast("double"), "item_offers_before")
        made["offer_vs_list"] = F.try_divide(offer, F.col(roles.price).cast("double"))
        made["offer_vs_past"] = F.try_divide(offer, past)
        made["offer_last"] = F.col("item_offer_last")
        made["offer_vs_last"] = F.try_divide(offer, F.col("item_offer_last"))
        made["offer_last_days"] = F.col("item_offer_last_days")
    return wide.select(
        *keep,
        *price,
        *[
            F.coalesce(made.get(n, F.col(n)).cast("double"), F.lit(NO_VALUE)).alias(FEATURE + n)
            for n in feature_names(roles, "amount")
        ],
    )


def _describe(
    items: DataFrame,
    per_item: DataFrame,
    nominal: list[list[str]],
    priors: Column,
    roles: Roles,
    target: Target,
) -> tuple[DataFrame, dict[str, Row]]:
    """The items with the encodings of their attributes, ``<name>`` and ``_by_fold_<name>``.

    ``per_item`` has the counts of the contacts of each item. One aggregate serves all
    encodings. The second result has, per encoding, the row for items that are not
    listed, whose attributes are all NULL.
    """
    if not nominal:
        return items, {}
    names = {target.name(keys): crossed(*keys) for keys in nominal}
    cells = [
        F.struct(F.lit(name).alias("_name"), value.alias("_value"))
        for name, value in names.items()
    ]
    needed = items.select(roles.item, *dict.fromkeys(k for keys in nominal for k in keys if k != roles.item))
    sums = {c: f"_{c}" for c in per_item.columns if c != roles.item}
    counted = (
        attach_items(per_item.withColumnsRenamed(sums), needed, roles.item, unique=True)
        .withColumn("_cell", F.explode(F.array(*cells)))
        .select(*[F.col(new).alias(old) for old, new in sums.items()], "_cell._name", "_cell._value")
    )
    whole, by_fold = encoding_columns(priors, roles.m, roles.n_folds, tag=target.tag)
    table = stage(
        roll_up(counted, ["_name", "_value"], roles.n_folds, [target.tag]).select(
            F.col("_name").alias("name"),
            F.col("_value").alias("value"),
            whole.alias("whole"),
            by_fold.alias("by_fold"),
        )
    )
    nothing = [r"|".join([r"\N"] * len(keys)) for keys in nominal]
    unlisted = {
        r["name"]: r
        for r in table.filter(
            F.struct("name", "value").isin(
                *[F.struct(F.lit(n), F.lit(v)) for n, v in zip(names, nothing)]
            )
        ).collect()
    }
    small = fits_broadcast(table)
    described = items
    for name, value in names.items():
        own = table.filter(F.col("name") == name).select(
            F.col("value").alias("_value"),
            F.col("whole").alias(name),
            F.col("by_fold").alias(f"_by_fold_{name}"),
        )
        described = lookup_join(
            described.withColumn("_value", value),
            own,
            ["_value"],
            row_id=[roles.item],
            small=small or None,
        ).drop("_value")
        # NULL is left to items that are not listed
        described = described.withColumn(name, F.coalesce(F.col(name), priors[0]))
    return stage(described), unlisted


def _mean_offer() -> Column:
    return F.try_divide(F.col("offer").cast("double"), F.col("offers"))


def _with_last_offer(daily: DataFrame, key: str) -> tuple[DataFrame, list[Column]]:
    """The daily table with the mean offer of the item's last earlier day that had one, and its columns."""
    value = F.when(F.col("offers") > 0, F.struct(F.col("_day").alias("day"), _mean_offer().alias("mean")))
    days = carried(daily.withColumn("_offer", value), key, "_day", "_offer", "_offer_last")
    since = F.date_diff("_day", F.col("_offer_last.day"))
    return days, [F.col("_offer_last.mean").alias("item_offer_last"), since.alias("item_offer_last_days")]


def training_features(
    contacts: DataFrame, items: DataFrame, roles: Roles
) -> tuple[Forecaster, DataFrame]:
    """Statistics of the training contacts, and the contacts with features.

    The contacts are read once per item and day, once per user and day, and once for
    the rows themselves; other statistics are added up from those two daily tables. An
    encoding of item attributes joins the items, and one of the user or item its
    history, so the contacts meet three tables however many encodings there are. Only
    encodings that mix both sides take another pass and another join.
    """
    row_id, n_folds, m = [roles.row_id], roles.n_folds, roles.m
    columns = contacts.columns
    _check_names(contacts, roles)
    # a hash, so that folds are even whatever the ids look like
    contacts = contacts.withColumn("_fold", F.xxhash64(roles.row_id))
    sides, targets = _sides(roles), _targets(roles)
    ready = prepare_items(items, roles)
    attributes = set(ready.columns) - {roles.item}
    kind = {"own": {}, "items": {}, "mixed": {}}
    for t in targets:
        of_key = [keys for keys in t.nominal if keys in [[k] for k in sides.values()]]
        of_items = [keys for keys in t.nominal if set(keys) <= attributes]
        mixed = [keys for keys in t.nominal if keys not in of_key + of_items]
        for name, some in zip(kind, (of_key, of_items, mixed)):
            kind[name][t] = some

    daily = {}
    folds = _fold_columns(roles)
    for side, key in sides.items():
        measures = _measures(roles, side)
        daily[side] = stage(daily_sums(contacts, key, roles.ts, measures, folds))
    # the mean of each label, over all contacts and without each fold
    row = daily["item"].agg(*[label_means(n_folds, t.tag).alias(f"means{t.tag}") for t in targets]).first()
    means = {t: row[f"means{t.tag}"] for t in targets}
    priors = {t: F.array(*[F.lit(v).cast("double") for v in means[t]]) for t in targets}
    defaults = {t.name(keys): means[t][0] or 0.0 for t in targets for keys in t.nominal}

    totals, histories = {}, {}
    for side, key in sides.items():
        measures, in_history, in_totals, days = _measures(roles, side), [], [], daily[side]
        for t in targets:
            if [key] in kind["own"][t]:
                name = t.name([key])
                by_fold = encoding_columns(priors[t], m, n_folds, W.partitionBy(key), t.tag)[1]
                in_history.append(by_fold.alias(f"_by_fold_{name}"))
                s, n = (F.sum(total(letter + t.tag, range(n_folds))) for letter in "sn")
                in_totals.append(smoothed(s.cast("double"), n, priors[t][0], m).alias(name))
        if side == "item" and roles.offer:
            days, last = _with_last_offer(days, key)
            in_history += last
            seen = F.when(F.col("offers") > 0, F.col("_day"))
            in_totals += [F.max_by(_mean_offer(), seen).alias("item_offer_last"), F.max(seen).alias("item_offer_last_day")]
        histories[side] = stage(history_table(days, key, measures, side, in_history))
        totals[side] = stage(history_totals(daily[side], key, measures, side, in_totals))

    tags = [t.tag for t in targets]
    per_item = roll_up(daily["item"], [roles.item], n_folds, tags)
    described, unlisted = ready, {}
    for t in targets:
        described, rest = _describe(described, per_item, kind["items"][t], priors[t], roles, t)
        unlisted |= rest
    defaults |= {name: row["whole"] for name, row in unlisted.items()}
    of_items = [t.name(keys) for t in targets for keys in kind["items"][t]]

    wide = attach_items(contacts, described, roles.item, row_id, unique=True)
    wide = wide.drop(*of_items)
    for side, key in sides.items():
        wide = history_join(wide, histories[side], key, roles.ts, row_id)
    encodings = {}
    every = [keys for t in targets for keys in kind["mixed"][t]]
    for at, keys in enumerate(every):
        if keys in every[:at]:
            continue
        needed = ready.select(roles.item, *[k for k in keys if k in attributes])
        rows = attach_items(contacts, needed, roles.item, row_id, unique=True)
        counts = stage(rows.groupBy(*keys).agg(*_fold_columns(roles)))
        for t in targets:
            if keys not in kind["mixed"][t]:
                continue
            name = t.name(keys)
            encodings[name] = stage(encodings_from_counts(counts, keys, m, n_folds, name, t.tag))
            table = encodings[name].select(
                *keys, "n_rows", F.col("by_fold").alias(f"_by_fold_{name}")
            )
            wide = lookup_join(wide, table, keys, "n_rows", row_id=row_id)
    own = fold_of("_fold", n_folds)
    for name in _encodings(roles):
        values = F.col(f"_by_fold_{name}")
        if name in unlisted:
            values = F.coalesce(values, F.array(*map(F.lit, unlisted[name]["by_fold"])))
        wide = wide.withColumn(name, values[own])
    fitted = Forecaster(
        roles=roles,
        items=described.drop(*[f"_by_fold_{name}" for name in of_items]),
        totals=totals,
        encodings=encodings,
        defaults=defaults,
    )
    return fitted, _finished(wide, roles, columns)


def prepare_training(
    contacts: DataFrame, items: DataFrame, roles: Roles
) -> tuple[Forecaster, DataFrame]:
    """``training_features`` with the columns the layers need written to the shared folder."""
    fitted, rows = training_features(contacts, items, roles)
    kept = dict.fromkeys([*feature_columns(roles, "amount"), roles.buy, roles.amount])
    return fitted, stage(rows.select(*kept))


def fit_forecaster(
    contacts: DataFrame, items: DataFrame, roles: Roles, **params
) -> Forecaster:
    """Fit both layers on ``contacts``; the second on those that bought.

    Growing trees is a long row of short jobs, so the layers, which do not depend on
    each other, are fitted side by side.
    """
    fitted, train = prepare_training(contacts, items, roles)
    names = feature_columns(roles)
    buyers = train.filter(F.col(roles.buy) == 1)
    keep_settings = inheritable_thread_target(train.sparkSession)
    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(keep_settings(fit_buy_layer), train, names, roles.buy, **params)
        second = pool.submit(
            keep_settings(fit_amount_layer), buyers, feature_columns(roles, "amount"), roles.amount, **params
        )
        fitted.buy_layer, fitted.amount_layer = first.result(), second.result()
    return fitted
