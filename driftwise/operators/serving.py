"""Request bodies to log rows: nested JSON ``{reading, history[]}`` read as VARIANT (P14), checked element by element,
turned into feature rows (C4), scored by a model kept as coefficient rows (C5) and shaped like the prediction log (S8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.exprs import as_ntz, col as qcol, epoch_micros, parse_double
from driftwise.operators.scoring import feature_rows
from driftwise.params import POLLUTANT_ALIASES

INTERCEPT = "(intercept)"
ERRORS = "array<struct<path:string,reason:string>>"


def _members(fields: Sequence[str]) -> list[str]:
    """The members that an observation is asked for: city, date, and each number field with its aliases behind it."""
    names = ["city", "date"]
    for field in fields:
        names += [field, *[alias for alias, canonical in POLLUTANT_ALIASES.items() if canonical == field and alias != field]]
    return list(dict.fromkeys(names))


def _taken(v: Column, path: str, fields: Sequence[str], many: bool) -> tuple[Column, Column]:
    """The asked members of one observation, or of a list of them, as text (``m0``, ``m1``, ...: names may differ by case only),
    and ``city`` and ``date`` as bytes, which only a JSON text has. Null where the value is no object (list)."""
    names, form = _members(fields), "array<struct<{}>>" if many else "struct<{}>"
    text = F.try_variant_get(v, path, form.format(", ".join(f"`{n}`: string" for n in names)))
    return (text.cast(form.format(", ".join(f"m{i}: string" for i in range(len(names))))),
            F.try_variant_get(v, path, form.format("city: binary, date: binary")))


def _texts(x: Column, raw: Column, fields: Sequence[str]) -> Column:
    """What is asked of one observation, from what ``_taken`` gives: the kind (STRING, VOID for none or a JSON null, OTHER) and
    text of ``city`` and ``date``, then the text of each number field under its canonical name or else its alias. Null where
    the item is null."""
    names, parts = _members(fields), []
    for i, name in enumerate(("city", "date")):
        kind = F.when(raw[name].isNotNull(), "STRING").when(x[f"m{i}"].isNull(), "VOID").otherwise("OTHER")
        parts += [kind.alias(f"{name}_kind"), x[f"m{i}"].alias(name)]
    for i, field in enumerate(fields):
        parts.append(F.coalesce(*[x[f"m{names.index(n)}"] for n in _members([field])[2:] or [field]]).alias(f"t{i}"))
    return F.when(x.isNotNull(), F.struct(*parts))


def _numbers(t: Column, n: int) -> Column:
    """``_texts`` with each number field's value beside its text."""
    return F.when(t.isNotNull(), F.struct(t["city_kind"].alias("city_kind"), t["city"].alias("city"), t["date_kind"].alias("date_kind"),
                                          t["date"].alias("date"), *[t[f"t{i}"].alias(f"t{i}") for i in range(n)],
                                          *[parse_double(t[f"t{i}"]).alias(f"n{i}") for i in range(n)]))


def _observation(x: Column, fields: Sequence[str]) -> Column:
    return F.struct(x["city"].alias("city"), x["date"].alias("date"), *[x[f"n{i}"].alias(f) for i, f in enumerate(fields)])


def _observation_errors(x: Column, path: Column, fields: Sequence[str]) -> Column:
    def error(at: str, reason: str) -> Column:
        return F.struct(F.concat(path, F.lit(at)).alias("path"), F.lit(reason).alias("reason"))

    found, fine = [], x.isNotNull()
    for name in ("city", "date"):
        kind = x[f"{name}_kind"]
        found.append(F.when(kind == "VOID", error(f".{name}", "missing")).when(kind != "STRING", error(f".{name}", "not text")))
        fine = fine & (kind == "STRING")
    for i, f in enumerate(fields):
        bad = x[f"t{i}"].isNotNull() & x[f"n{i}"].isNull()
        found.append(F.when(bad, error(f".{f}", "not a number")))
        fine = fine & ~bad
    return (F.when(fine, F.array().cast(ERRORS)).when(x.isNull(), F.array(error("", "not an object")).cast(ERRORS))
            .otherwise(F.array_compact(F.array(*found)).cast(ERRORS)))


def parse_requests(df: DataFrame, body_col: str, id_col: str, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep, reading, history, errors) per body.

    ``city`` and ``date`` of the reading and of every history element must be JSON text; each number field may be absent or
    null, else it must be a number (or its text). ``history`` may be absent; null or anything but a list is an error. Each
    fault has its own (path, reason) entry, in the order of the body; a request without entries is accepted. A body that is
    null, no JSON, or repeats a member is one fault (``body``, ``not JSON``). ``history`` is null where it is no list."""
    body = F.try_parse_json(qcol(body_col))
    v = df.select(id_col, *keep, body.alias("_v"))
    (reading, raw_reading), (history, raw_history) = _taken(F.col("_v"), "$.reading", fields, False), _taken(F.col("_v"), "$.history", fields, True)
    v = v.select(id_col, *keep, "_v", reading.alias("_rs"), raw_reading.alias("_rb"), history.alias("_hs"), raw_history.alias("_hb"))

    def absent(parsed: str, path: str) -> Column:
        return F.col(parsed).isNull() & F.try_variant_get("_v", path, "variant").isNull()

    v = v.select(id_col, *keep, "_hs", "_hb", F.col("_v").isNull().alias("_no_json"), _texts(F.col("_rs"), F.col("_rb"), fields).alias("_rt"),
                 absent("_rs", "$.reading").alias("_no_r"), absent("_hs", "$.history").alias("_no_h"))
    # One generated row per body: a filter on what is derived from it stays above, so no body is taken apart twice.
    taken = F.struct("_no_json", "_no_r", "_no_h", _numbers(F.col("_rt"), len(fields)).alias("_r"),
                     F.transform(F.zip_with("_hs", "_hb", lambda x, raw: _texts(x, raw, fields)), lambda t: _numbers(t, len(fields))).alias("_h"))
    v = v.select(id_col, *keep, F.inline(F.array(taken)))

    def one(path: str, reason: str) -> Column:
        return F.array(F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason"))).cast(ERRORS)

    of_history = F.flatten(F.transform("_h", lambda x, i: _observation_errors(
        x, F.concat(F.lit("history["), i.cast("string"), F.lit("]")), fields)))
    none = F.array().cast(ERRORS)
    errors = F.when(F.col("_no_json"), one("body", "not JSON")).otherwise(F.concat(
        F.when(F.col("_no_r"), one("reading", "missing")).otherwise(_observation_errors(F.col("_r"), F.lit("reading"), fields)),
        F.when(F.col("_no_h"), none).when(F.col("_h").isNull(), one("history", "not a list")).otherwise(of_history)))
    history = F.when(F.col("_no_h"), F.array()).otherwise(F.transform("_h", lambda x: _observation(x, fields)))
    return v.select(id_col, *keep, _observation(F.col("_r"), fields).alias("reading"), history.alias("history"),
                    errors.alias("errors"))


def request_errors(parsed: DataFrame, id_col: str) -> DataFrame:
    """(id, path, reason), a row per fault."""
    return parsed.select(id_col, F.inline_outer("errors")).where(F.col("reason").isNotNull())


def least_squares(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """A linear model as rows (feature, weight), the constant under ``(intercept)``.

    Missing features count as 0.0 and rows without target are left out, as at scoring. One pass over the data gives the
    means and the covariances (one row, its width given by the features); the small system is solved on the driver. Features
    that others determine share the weight (least norm). Without labelled rows every weight is null."""
    names = [*cols, target]
    x = df.where(qcol(target).isNotNull()).select(
        *[F.coalesce(qcol(c).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(names)])
    k = len(cols)
    one = x.agg(*[F.avg(f"_{i}").alias(f"m{i}") for i in range(k + 1)],
                *[F.covar_pop(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k + 1)]).first()
    spark, schema = df.sparkSession, "feature string, weight double"
    if one["m0"] is None:
        return spark.createDataFrame([(n, None) for n in [INTERCEPT, *cols]], schema)
    cov = np.array([[one[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    w = np.linalg.lstsq(cov, np.array([one[f"c{i}_{k}"] for i in range(k)]), rcond=None)[0]
    b = one[f"m{k}"] - sum(float(w[i]) * one[f"m{i}"] for i in range(k))
    return spark.createDataFrame([(INTERCEPT, float(b)), *[(c, float(w[i])) for i, c in enumerate(cols)]], schema)


def linear_score(weights: Mapping[str, float | None]) -> Column:
    """The model as one expression over feature columns; null where a weight is null."""
    out = F.lit(weights[INTERCEPT]).cast("double")
    for feature, w in weights.items():
        if feature != INTERCEPT:
            out = out + F.lit(w).cast("double") * qcol(feature).cast("double")
    return out


def log_rows(parsed: DataFrame, id_col: str, received_col: str, fields: Sequence[str], model: DataFrame, model_version: str,
             model_family: str, created_at) -> DataFrame:
    """C5 + S8: a prediction-log row per accepted request (id, created_at, model_version, model_family, input_features,
    predicted_aqi, latency_ms).

    The id is the request's own, so a repeated run gives the same rows. ``input_features`` is the reading as JSON with its
    nulls; ``latency_ms`` runs from the request's arrival to ``created_at``. ``model`` holds (feature, weight) rows; it has one
    row per feature and becomes literals of one expression."""
    weights = {r["feature"]: r["weight"] for r in model.collect()}          # one row per feature
    features = [f for f in weights if f != INTERCEPT]
    ok = parsed.where(F.size("errors") == 0).withColumn("_carried", F.struct(id_col, received_col, "reading"))
    rows = feature_rows(ok, features, fields, key="_carried")
    stamp = as_ntz(created_at)
    return rows.select(
        F.col("_carried")[id_col].alias("id"), stamp.alias("created_at"), F.lit(model_version).alias("model_version"),
        F.lit(model_family).alias("model_family"),
        F.to_json(F.col("_carried")["reading"], {"ignoreNullFields": "false"}).alias("input_features"),
        linear_score(weights).alias("predicted_aqi"),
        ((epoch_micros(stamp) - epoch_micros(F.col("_carried")[received_col])) / 1000.0).alias("latency_ms"))
