"""Data-parallel training of a chain by two-site sweeps.

The driver holds the chain. Each update of a merged pair of sites is one small Spark job
over blocks of states (``blocks``), which keep the environments of the sweep: tasks sum
the loss and gradient of their own series, and Spark adds the sums up. Nothing grows with
the number of series but the tasks. Series whose states fit one partition of ``PARTITION_BYTES``
are swept in one task, by the same functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.encodings import ENCODINGS
from chainloom.functions.fitted import FittedEncoding, fitted, parsed
from chainloom.functions.scaling import scaled
from chainloom.operators.blocks import HalfSweep, TaskHalfSweep, block_summary, state_blocks
from chainloom.operators.mps import Chain, compressed, left_orthogonal, merged, random_chain, split, sum_of_products
from chainloom.operators.prediction import scores, states, summary
from chainloom.operators.series import asserted, hashed, sampled_per_class


PER_SWEEP = ("rate", "iterations", "solver", "loss", "max_bond", "cutoff")


@dataclass(frozen=True)
class Options:
    encoding: str | FittedEncoding = "stoudenmire"  # composite names are fitted on the training set
    d: int = 2
    inner_d: int = 2  # components within a bin of a split encoding
    encode_by_class: bool = False  # lists of a fitted encoding by class
    max_bond: int = 10
    first_bond: int = 4
    sweeps: int = 5
    rate: float = 0.05
    iterations: int = 1
    solver: str = "tsgo"  # tsgo, descent, careful or conjugate
    loss: str | Callable = "kld"  # kld, mse, mixed, normalised, or a function like those
    separate_classes: bool = False
    rescale: bool = True
    cutoff: float = 1e-10
    stop_below: float | None = None
    partition: bool = False  # adds log |B|^2: with one class, the likelihood of a state of any norm
    norm_penalty: float = 0.0  # adds this times (|B|^2 - 1)^2 / 2
    seed: int = 456

    def of_sweep(self, sweep: int) -> Options:
        """Options given as lists hold a value for each sweep, the last one for all after it."""
        lists = {k: v for k in PER_SWEEP if isinstance(v := getattr(self, k), (list, tuple))}
        return replace(self, **{k: v[min(sweep, len(v)) - 1] for k, v in lists.items()})

    def changed(self, **values) -> Options:
        unknown = values.keys() - self.__dataclass_fields__.keys()
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return replace(self, **values)


def kld(y: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-log |y_label|^2 and what the gradient gets of each row and class."""
    rows = np.arange(len(y))
    f = y[rows, label]
    weight = np.zeros_like(y)
    weight[rows, label] = -1 / f.conj()
    return -2 * np.log(np.abs(f)), weight


kld.shift = -2.0  # see blocks.summed


def squared_error(y, label):
    target = np.zeros_like(y)
    target[np.arange(len(y)), label] = 1
    return 0.5 * (np.abs(y - target) ** 2).sum(axis=1), y - target


def mixed(y, label, alpha: float = 5.0):
    a, b = kld(y, label), squared_error(y, label)
    return a[0] + alpha * b[0], a[1] + alpha * b[1]


def normalised(y, label):
    """-log of the share of the true class among all squared amplitudes."""
    loss, weight = kld(y, label)
    total = (np.abs(y) ** 2).sum(axis=1)
    return loss + np.log(total), weight + y / total[:, None]


normalised.shift = 0.0
LOSSES = {"kld": kld, "mse": squared_error, "mixed": mixed, "normalised": normalised}


def class_shares(counts: dict[int, int], separate: bool) -> np.ndarray:
    """What one series of each class weighs: 1 / all, or 1 / its class."""
    total = sum(counts.values())
    return np.array([1 / counts[c] if separate else 1 / total for c in sorted(counts)])


def loss_and_gradient(half: HalfSweep | TaskHalfSweep, bond: np.ndarray, j: int, options: Options, counts: dict[int, int]) -> tuple[float, np.ndarray]:
    """The mean loss and the gradient with respect to the conjugate of the merged tensor of
    sites j and j + 1. With ``separate_classes`` each class is divided by its own count."""
    loss_of = LOSSES[options.loss] if isinstance(options.loss, str) else options.loss
    values = half.sums(bond, j, class_shares(counts, options.separate_classes), loss_of)
    loss, gradient, square = float(values[0].real), values[1:].reshape(bond.shape), float(np.vdot(bond, bond).real)
    if options.partition:
        loss, gradient = loss + np.log(square), gradient + bond / square
    if options.norm_penalty:
        loss, gradient = loss + options.norm_penalty * (square - 1) ** 2 / 2, gradient + 2 * options.norm_penalty * (square - 1) * bond
    return loss, gradient


def encoding_of(train: DataFrame, options: Options) -> FittedEncoding:
    if isinstance(options.encoding, FittedEncoding):
        return options.encoding
    return fitted(train, options.encoding, options.d, options.inner_d, options.encode_by_class)


def sum_state_start(train: DataFrame, options: Options, per_class: int = 8, noise: float = 0.0) -> Chain:
    """A chain that superposes the states of ``per_class`` series of each class, compressed to the first bond."""
    chosen, e = sampled_per_class(train, per_class, hashed(options.seed)), encoding_of(train, options)
    rows = states(chosen.select("series_id", F.col("label").cast("int").alias("label"), "x"), e, None, "series_id", "label").orderBy("series_id").collect()
    phi = np.array([np.array(r.re) + 1j * np.array(r.im) for r in rows]).reshape(len(rows), -1, e.d)
    chain = compressed(sum_of_products(phi, [r.label for r in rows], 1 + max(r.label for r in rows)), options.first_bond, options.cutoff)
    if not noise:
        return chain
    rng = np.random.default_rng(options.seed)
    return left_orthogonal([t + noise * rng.normal(size=t.shape) * np.abs(t).max() for t in chain.tensors]).normalised()


def updated(bond: np.ndarray, evaluate, options: Options) -> np.ndarray:
    """``iterations`` steps of the solver on a merged tensor; ``evaluate`` gives loss and gradient."""
    solver = options.solver.lower()
    if options.rescale:
        bond = bond / np.linalg.norm(bond)
    loss, g = evaluate(bond) if options.iterations else (0.0, None)
    direction = None
    for step in range(options.iterations):
        if solver == "tsgo":
            new = bond - options.rate * g / max(np.linalg.norm(g), 1e-300)
        elif solver in ("descent", "careful"):
            new = bond - options.rate * g
        elif solver == "conjugate":
            if direction is None:
                direction = -g
            else:
                beta = max(0.0, np.vdot(g, g - before).real / max(np.vdot(before, before).real, 1e-300))
                direction = -g + beta * direction
            if np.vdot(g, direction).real >= 0:
                direction = -g
            size, slope = 1.0, np.vdot(g, direction).real
            while size > 1e-8 and not evaluate(bond + size * direction)[0] <= loss + 1e-4 * size * slope:
                size /= 4
            if size <= 1e-8:  # no step lowers the loss
                break
            new, before = bond + size * direction, g
        else:
            raise ValueError(f"unknown solver {options.solver}")
        if solver == "careful" or step + 1 < options.iterations:
            new_loss, new_g = evaluate(new)
            if solver == "careful" and new_loss > loss:
                break
            loss, g = new_loss, new_g
        bond = new
    return bond / np.linalg.norm(bond) if options.rescale else bond


def swept(half: HalfSweep | TaskHalfSweep, chain: Chain, to_left: bool, options: Options, counts: dict[int, int]) -> Chain:
    """One half sweep: every pair of neighbouring sites is updated, from the right end on or from the left."""
    for j in range(chain.length - 2, -1, -1) if to_left else range(chain.length - 1):
        bond = updated(merged(chain, j), lambda b, j=j: loss_and_gradient(half, b, j, options, counts), options)
        if not np.isfinite(bond).all():
            raise FloatingPointError(f"sites {j} and {j + 1}: the tensor isn't finite")
        chain = split(chain, j, bond, to_left, options.max_bond, options.cutoff)
        site = j + 1 if to_left else j
        half.advance(site, chain.tensors[site])
    half.close()
    return chain


def sweep_of(blocks: RDD, chain: Chain, options: Options, counts: dict[int, int]) -> Chain:
    """To the left and back. In one task where there is one partition, else by a job for each update."""
    if blocks.getNumPartitions() > 1:
        for to_left in (True, False):
            chain = swept(HalfSweep(blocks, chain, to_left), chain, to_left, options, counts)
        return chain

    def run(held):
        held, now = list(held), chain
        try:
            for to_left in (True, False):
                now = swept(TaskHalfSweep(held, now, to_left), now, to_left, options, counts)
        except FloatingPointError as error:  # for the driver: no other attempt would end better
            return [error]
        return [now]

    found = blocks.mapPartitions(run).collect()[0]  # the chain
    if isinstance(found, Exception):
        raise found
    return found


def fit(train: DataFrame, test: DataFrame | None, options: Options, start: Chain | None = None) -> tuple[Chain, list[dict]]:
    """Series with labels 0 to C - 1 and values in the encoding's range. Returns the chain and a log:
    before training (sweep 0), after each sweep, and after the final normalisation. ``stop_below``
    ends the sweeps when the KLD falls by less, on the test set if there is one. The chain holds the encoding,
    which is fitted on ``train`` where the options name a composite one."""
    length = asserted(train)
    counts = {r["label"]: r["count"] for r in train.groupBy(F.col("label").cast("int").alias("label")).count().collect()}  # one row for each class
    if sorted(counts) != list(range(len(counts))):
        raise ValueError(f"labels must be 0 to C - 1, not {sorted(counts)}")
    encoding = encoding_of(train, options)
    chain = replace(start or random_chain(length, encoding.d, options.first_bond, len(counts), options.seed), encoding=encoding)
    rows_of = {name: rows for name, rows in (("train", train), ("test", test)) if rows is not None}
    sets = {name: state_blocks(rows, encoding, None) for name, rows in rows_of.items() if name == "train" or not encoding.by_class}
    judged = "test_kld" if test is not None else "train_kld"
    log: list[dict] = []

    def note(sweep: int, seconds: float) -> None:
        entry = {"sweep": sweep, "seconds": seconds}
        for name, rows in rows_of.items():
            # blocks hold each series in the encoding of its own class alone
            found = summary(scores(rows, chain)).first().asDict() if encoding.by_class else block_summary(sets[name], chain)
            entry |= {f"{name}_{k}": found[k] for k in ("accuracy", "kld", "mse")}
        log.append(entry)

    try:
        note(0, 0.0)
        for sweep in range(1, options.sweeps + 1):
            now, began = options.of_sweep(sweep), time.monotonic()
            try:
                chain = sweep_of(sets["train"], chain, now, counts)
            except FloatingPointError as error:
                raise FloatingPointError(f"sweep {sweep}, {error}") from None
            note(sweep, time.monotonic() - began)
            if options.stop_below is not None and 0 < log[-2][judged] - log[-1][judged] < options.stop_below:
                break
        chain = chain.normalised()
        note(len(log), log[-1]["seconds"])
    finally:
        for blocks in sets.values():
            blocks.unpersist()
    return chain, log


def fit_scaled(train: DataFrame, test: DataFrame | None, options: Options, minmax_fit: str = "self") -> tuple[Chain, list[dict]]:
    """``fit`` on raw series: a robust sigmoid fitted on ``train``, then the range of the encoding."""
    e = options.encoding if isinstance(options.encoding, FittedEncoding) else ENCODINGS[parsed(options.encoding).inner]
    sets = scaled(train, *([test] if test is not None else []), to=(e.low, e.high), minmax_fit=minmax_fit)
    return fit(sets[0], sets[1] if test is not None else None, options)
