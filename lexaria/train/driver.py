"""Epoch driver (K6) and evaluation during training (K7)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.operators import losses as L
from lexaria.operators import sampling as S
from lexaria.sinks.vectors import stage_done
from lexaria.train import model as M


@dataclass
class TrainConfig:
    """The reference's training defaults."""

    epochs: int = 15
    batch_size: int = 128
    learning_rate: float = 1e-4
    temperature: float = 0.05
    patience: int = 5
    grad_clip: float = 5.0
    seed: int = 42
    eval_every: int = 1  # evaluate every N passes (0 disables)
    steps_per_pass: int = 1  # optimiser steps per pass, each over its share of the batches
    weight_decay: float = 0.01  # of the regression optimiser (AdamW)


@dataclass
class TrainResult:
    params: DataFrame
    history: list = field(default_factory=list)
    best_epoch: int = -1


def _batches(sents: DataFrame, teacher: DataFrame, cfg: TrainConfig, epoch: int) -> DataFrame:
    b = S.epoch_batches(sents, "sent_id", cfg.batch_size, epoch, cfg.seed)
    return b.join(teacher.select("sent_id", "tvec"), "sent_id")


def _steps(batches: DataFrame, cfg: TrainConfig):
    """(step, its batches): every batch of the pass belongs to exactly one step."""
    if cfg.steps_per_pass == 1:
        return [(0, batches)]
    batches = batches.checkpoint(eager=True)
    return [(s, batches.where(F.pmod("batch_id", F.lit(cfg.steps_per_pass)) == s)) for s in range(cfg.steps_per_pass)]


def cosine_rate(rate: float, step: int, total: int) -> float:
    """Cosine decay to zero: the rate of 0-based ``step`` out of ``total``."""
    return 0.5 * rate * (1 + math.cos(math.pi * step / max(1, total)))


def validation_loss(params: DataFrame, val_batches: DataFrame, cfg: TrainConfig,
                    bound: int | None = None, dim: int | None = None) -> float:
    """Mean E23 over the fixed validation batches."""
    bl = M.distillation_losses(val_batches, params, cfg.temperature, dim)
    return float(L.epoch_loss(bl).first()["epoch_loss"])


def train_distillation(spark: SparkSession, params: DataFrame, train: DataFrame, val: DataFrame,
                       teacher: DataFrame, out_dir: str, cfg: TrainConfig = TrainConfig(),
                       evaluate=None, bound: int | None = None, dim: int | None = None) -> TrainResult:
    """K6: one synchronous step per pass; validation loss; strict-improvement best
    table; early stop after ``patience`` passes without improvement; every pass is
    written (and a finished pass is reloaded on resume).  ``evaluate`` (K7) is
    called with the current vector table and its result recorded."""
    result = TrainResult(params)
    best, since = float("inf"), 0
    # fixed inputs of every pass: materialised once (reliable checkpoints)
    teacher = teacher.select("sent_id", "tvec").checkpoint(eager=True)
    val_batches = _batches(val, teacher, cfg, 0).checkpoint(eager=True)
    for epoch in range(cfg.epochs):
        path = f"{out_dir.rstrip('/')}/epoch={epoch}"
        if stage_done(spark, path):
            params = spark.read.parquet(path)
            train_loss = None
        else:
            everything = _batches(train, teacher, cfg, epoch)
            seen = []
            for step, b in _steps(everything, cfg):
                # the gradient table comes stored: the norm and the update do not recompute the pass
                grad, losses = M.distillation_gradient(b.select("batch_id", "i", "text", "tvec"), params,
                                                       temperature=cfg.temperature, bound=bound, dim=dim)
                got = L.epoch_loss(losses).first()["epoch_loss"]
                if got is None:  # no batch fell to this step
                    continue
                seen.append(float(got))
                params = M.adam_step(params, grad, epoch * cfg.steps_per_pass + step + 1, cfg.learning_rate, cfg.grad_clip)
                params = params.checkpoint(eager=True)
            train_loss = sum(seen) / len(seen) if seen else None
            params.write.mode("overwrite").parquet(path)  # cuts the lineage
            params = spark.read.parquet(path)
        val_loss = validation_loss(params, val_batches, cfg, bound, dim)
        is_best = val_loss < best
        if is_best:
            best, since, result.best_epoch = val_loss, 0, epoch
            result.params = params
        else:
            since += 1
        row = {"epoch": epoch, "train_loss": train_loss, "val_loss": val_loss, "is_best": is_best}
        if evaluate is not None and cfg.eval_every > 0 and (epoch + 1) % cfg.eval_every == 0:
            row["metrics"] = evaluate(M.vectors_of(params))
        else:
            row["metrics"] = None
        result.history.append(row)
        if since >= cfg.patience:
            break
    return result


def _matrix_table(spark: SparkSession, w: np.ndarray, m: np.ndarray, v: np.ndarray) -> DataFrame:
    """A k x d parameter and its moments as k rows."""
    rows = [(i, w[i].tolist(), m[i].tolist(), v[i].tolist()) for i in range(len(w))]
    return spark.createDataFrame(rows, "r int, w array<double>, m array<double>, v array<double>")


def _read_matrix(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = df.orderBy("r").collect()  # k rows, a bounded parameter
    return tuple(np.array([r[c] for r in rows]) for c in ("w", "m", "v"))


def adamw_matrix(w, m, v, g, step: int, rate: float, decay: float, beta1=0.9, beta2=0.999, eps=1e-8):
    """One AdamW step of a dense parameter: (w, m, v)."""
    w = w * (1 - rate * decay)
    m, v = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * g * g
    return w - rate * (m / (1 - beta1 ** step)) / (np.sqrt(v / (1 - beta2 ** step)) + eps), m, v


def train_regression(spark: SparkSession, params: DataFrame, texts: DataFrame, targets: DataFrame, weight: np.ndarray,
                     out_dir: str, cfg: TrainConfig = TrainConfig(), evaluate=None,
                     bound: int | None = None, dim: int | None = None):
    """K6, regression form: AdamW with cosine decay on token vectors and projection together.

    A pass deals the texts to ``steps_per_pass`` steps by hash; every step is one synchronous
    update over its share.  Token vectors, projection and both moments are written after each
    pass and a finished pass is reloaded, so a restarted run goes on where it stopped.  The
    best pass has the lowest mean loss.  Returns ``(TrainResult, projection)``.
    """
    result, best, total = TrainResult(params), float("inf"), cfg.epochs * cfg.steps_per_pass
    w, m, v = weight, np.zeros_like(weight), np.zeros_like(weight)
    best_w = w
    for epoch in range(cfg.epochs):
        path, proj = (f"{out_dir.rstrip('/')}/{x}={epoch}" for x in ("epoch", "projection"))
        if stage_done(spark, path) and stage_done(spark, proj):
            params = spark.read.parquet(path)
            w, m, v = _read_matrix(spark.read.parquet(proj))
            loss = spark.read.json(f"{out_dir.rstrip('/')}/loss={epoch}").first()["loss"]
        else:
            share = F.pmod(F.xxhash64("text_id", F.lit(cfg.seed), F.lit(epoch)), F.lit(cfg.steps_per_pass))
            dealt, aims = texts.withColumn("_s", share), targets.withColumn("_s", share)
            losses = []
            found = {r["_s"] for r in dealt.select("_s").distinct().collect()}  # a number a step
            steps = [s for s in range(cfg.steps_per_pass) if s in found]
            for s in steps:
                step = epoch * cfg.steps_per_pass + s
                part = dealt.where(F.col("_s") == s).drop("_s")
                grad, dw, loss = M.regression_gradient(part, params, aims.where(F.col("_s") == s).drop("_s"), w, bound=bound, dim=dim)
                rate = cosine_rate(cfg.learning_rate, step, total)
                params = M.adam_step(params, grad, step + 1, rate, None, weight_decay=cfg.weight_decay)
                if s != steps[-1]:  # the last table of a pass is stored where it is written
                    params = params.checkpoint(eager=True)
                w, m, v = adamw_matrix(w, m, v, dw, step + 1, rate, cfg.weight_decay)
                losses.append(float(loss))
            loss = float(np.mean(losses))
            params.write.mode("overwrite").parquet(path)
            spark.createDataFrame([(loss,)], "loss double").write.mode("overwrite").json(f"{out_dir.rstrip('/')}/loss={epoch}")
            _matrix_table(spark, w, m, v).write.mode("overwrite").parquet(proj)
            params = spark.read.parquet(path)
        is_best = loss < best
        if is_best:
            best, best_w, result.best_epoch, result.params = loss, w, epoch, params
        due = evaluate is not None and cfg.eval_every > 0 and (epoch + 1) % cfg.eval_every == 0
        result.history.append({"epoch": epoch, "train_loss": loss, "val_loss": None, "is_best": is_best,
                               "metrics": evaluate(M.vectors_of(params)) if due else None})
    return result, best_w


def train_contrastive(spark: SparkSession, params: DataFrame, pairs: DataFrame, out_dir: str,
                      cfg: TrainConfig = TrainConfig(learning_rate=1e-3), n_val: int = 10_000,
                      bound: int | None = None, dim: int | None = None) -> TrainResult:
    """K6, cross-lingual form: both-direction in-batch loss over aligned ``(pair_id, src, tgt)``.

    The last ``n_val`` pairs are validation; every step is validated, and training stops after
    ``patience`` steps without improvement.  Every step's table is written and reloaded on resume.
    """
    result, best, since = TrainResult(params), float("inf"), 0
    marked = S.hold_out_last(pairs, n_val).checkpoint(eager=True)
    keep = ["batch_id", "i", "src", "tgt"]
    val = S.epoch_batches(marked.where("split = 'val'"), "pair_id", cfg.batch_size, 0, cfg.seed).select(*keep).checkpoint(eager=True)
    for epoch in range(cfg.epochs):
        b = S.epoch_batches(marked.where("split = 'train'"), "pair_id", cfg.batch_size, epoch, cfg.seed).select(*keep)
        for s, part in _steps(b, cfg):
            step = epoch * cfg.steps_per_pass + s
            path = f"{out_dir.rstrip('/')}/step={step}"
            train_loss = None
            if not stage_done(spark, path):
                grad, losses = M.contrastive_gradient(part, params, cfg.temperature, bound, dim)
                train_loss = losses.agg(F.sum("loss")).first()[0]
                M.adam_step(params, grad, step + 1, cfg.learning_rate, cfg.grad_clip).write.mode("overwrite").parquet(path)
            params = spark.read.parquet(path)
            losses = M.contrastive_losses(val, params, cfg.temperature, dim)
            val_loss = losses.agg(F.sum("loss")).first()[0]
            is_best = val_loss is not None and val_loss < best
            since = 0 if is_best else since + 1
            if is_best:
                best, result.best_epoch, result.params = val_loss, step, params
            result.history.append({"epoch": step, "train_loss": train_loss, "val_loss": val_loss, "is_best": is_best, "metrics": None})
            if since >= cfg.patience:
                return result
    return result
