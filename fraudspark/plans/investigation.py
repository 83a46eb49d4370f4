"""From transactions to cases: score the live window, gather the dossier of every flagged
event, decide, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.scalar import half_up
from fraudspark.functions.text import ist_string
from fraudspark.operators import decide as D
from fraudspark.operators import lookups as L
from fraudspark.operators.features import feature_frame
from fraudspark.operators.metrics import feature_stats
from fraudspark.operators.sampling import case_bank, window_bounds
from fraudspark.operators.scoring import LinearModel, batch_score
from fraudspark.operators.skew import DEFAULT, SkewPolicy
from fraudspark.schemas import FEATURES, HOUR_MS, PUBLIC_FIELDS
from fraudspark.sources.adapter import Tables
from fraudspark.sources.cache import DerivedTables
from fraudspark.sources.staging import stage

CASE_STATE = [
    "row_no",
    "n_before",
    "device_n_before",
    "device_users_before",
    "device_first_before_ms",
]
# Part of the name of kept feature tables: raise it with every change of a feature.
FEATURE_VERSION = 1
# Event columns that a feature of the same name would shadow.
SHADOWED = {"is_online": "online"}


@dataclass(frozen=True)
class Window:
    train_start: int
    val_start: int
    test_start: int
    end: int


def window_of(df: DataFrame, burn_in: float, val: float, test: float) -> Window:
    """Four numbers on the driver; the filters built from them reach the scan."""
    return Window(*window_bounds(df.select("ts_ms"), burn_in, val, test).first())


@dataclass(frozen=True)
class CaseWork:
    """Staged feature rows with event columns and state, and what the look-ups need."""

    rows: DataFrame
    tables: Tables
    window: Window
    model: LinearModel

    @property
    def train(self) -> DataFrame:
        w = self.window
        return self.rows.where(
            (F.col("ts_ms") >= w.train_start) & (F.col("ts_ms") < w.val_start)
        )

    @property
    def val(self) -> DataFrame:
        w = self.window
        return self.rows.where(
            (F.col("ts_ms") >= w.val_start) & (F.col("ts_ms") < w.test_start)
        )

    @property
    def live(self) -> DataFrame:
        return self.rows.where(F.col("ts_ms") >= self.window.test_start)

    def decisions(self, keep: list[str] = ()) -> DataFrame:
        return batch_score(self.live, self.model, keep=keep)

    def anchors(self) -> DataFrame:
        """Flagged events of the live window with their event, state and feature columns."""
        return self._flagged(self.live)

    def past_anchors(self) -> DataFrame:
        """The same from the validation window on: events before the label cutoff among them."""
        return self._flagged(self.rows.where(F.col("ts_ms") >= self.window.val_start))

    def _flagged(self, rows: DataFrame) -> DataFrame:
        kept = [
            c for c in self.rows.columns if c not in ("txn_id", "ts_ms", "user_id")
        ]
        return batch_score(rows, self.model, keep=kept).where("flagged")

    def history_rows(self) -> DataFrame:
        """Rows a history may show, with the score where the row was scored."""
        live = F.col("ts_ms") >= self.window.test_start
        score = F.when(live, half_up(self.model.score(self.rows.columns), 4))
        return self.rows.select(
            *[
                F.col(SHADOWED[c]).alias(c) if c in SHADOWED else F.col(c)
                for c in PUBLIC_FIELDS
            ],
            "row_no",
            score.alias("model_score"),
        )

    def bank(self) -> DataFrame:
        return case_bank(self.train.unionByName(self.val))

    def stats(self) -> dict[str, tuple[float, float]]:
        """45 means and deviations of the training window."""
        return {
            r["feature"]: (r["mean"], r["std"])
            for r in feature_stats(self.train, FEATURES, at_once=9).collect()
        }


def prepare(
    tables: Tables,
    model: LinearModel,
    burn_in: float = 7,
    val: float = 7,
    test: float = 7,
    policy: SkewPolicy = DEFAULT,
    kept: DerivedTables | None = None,
    sources: list[str] = (),
) -> CaseWork:
    """Features are computed once and staged, as every look-up reads them. So are transactions, as
    the surveys and windows behind the features read them many times over. With ``kept`` features
    are taken from there while the files under ``sources`` are the same."""
    keep = [*PUBLIC_FIELDS, "online", "context", *CASE_STATE]

    def features() -> DataFrame:
        txns = stage(tables.transactions.withColumn("online", F.col("is_online")), "transactions")
        return feature_frame(txns, tables.users, tables.merchants, policy, keep=keep)

    if kept is None:
        rows = stage(features(), "features")
    else:
        rows = kept.get(list(sources), f"{FEATURE_VERSION} {keep} {policy}", features)
    return CaseWork(rows, tables, window_of(rows, burn_in, val, test), model)


def history(work: CaseWork, anchors: DataFrame) -> DataFrame:
    # No event of the live window looks further back than this.
    oldest = work.window.test_start - L.HISTORY_HOURS * HOUR_MS
    rows = work.history_rows().where(F.col("ts_ms") >= oldest)
    return L.user_history(anchors, rows, L.HISTORY_HOURS, L.HISTORY_LIMIT)


def merchants_asof(work: CaseWork, anchors: DataFrame) -> DataFrame:
    cutoff = F.lit(work.window.test_start)
    rows = work.rows.select("merchant_id", "user_id", "amount", "ts_ms", "is_fraud")
    facts = L.merchant_facts(anchors, rows, cutoff)
    return L.merchant_asof(anchors, work.tables.merchants, facts, cutoff)


def devices_asof(work: CaseWork, anchors: DataFrame) -> DataFrame:
    cutoff = F.lit(work.window.test_start)
    rows = work.rows.select("device_id", "ts_ms", "is_fraud")
    return L.device_asof(anchors, L.confirmed_device_fraud(anchors, rows, cutoff), cutoff)


def similar(work: CaseWork, anchors: DataFrame, k: int = L.NEIGHBOURS) -> DataFrame:
    return L.similar_cases(anchors, work.bank(), work.stats(), k)


def dossier(work: CaseWork) -> DataFrame:
    """All six look-ups for every flagged event, one row each. Only flagged events are joined,
    and every look-up has one row per event."""
    anchors = stage(work.anchors(), "anchors")
    summary = L.history_summary(
        anchors, history(work, anchors), L.HISTORY_HOURS, D.history_signals()
    )
    merchant = merchants_asof(work, anchors).drop("merchant_id")
    device = devices_asof(work, anchors).drop("device_id")
    profile = L.user_profile(anchors, work.tables.users).drop("user_id")
    share = L.fraud_share(similar(work, anchors))
    reasons = F.transform(
        "reasons",
        lambda r: F.struct(
            r["feature"].alias("feature"),
            half_up(r["value"], 3).alias("value"),
            r["direction"].alias("effect"),
        ),
    )
    card = anchors.select(
        "txn_id",
        "ts_ms",
        "user_id",
        "merchant_id",
        "merchant_category",
        "device_id",
        "channel",
        half_up(F.col("amount"), 4).alias("amount"),
        "city",
        "country",
        F.col("online").alias("is_online"),
        ist_string(F.col("ts_ms")).alias("when"),
        half_up(F.col("score"), 4).alias("score"),
        half_up(F.col("threshold"), 4).alias("threshold"),
        "model_version",
        reasons.alias("top_reasons"),
    )
    out = card
    for part in (profile, summary, device, merchant, share):
        out = out.join(part, "txn_id", "left")
    return out.withColumn("speed_reason", D.speed_reason(F.col("top_reasons")))


def cases(work: CaseWork) -> DataFrame:
    """Verdict and report for every flagged event."""
    decided = D.decide(dossier(work)).withColumn("case_id", D.case_id(work.model.version))
    return D.case_report(decided)
