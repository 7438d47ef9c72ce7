"""Training series as blocks of states with the environments of a sweep kept beside them.

A block holds labels and conjugate states of some rows of one partition. A half sweep goes over them in windows of
``KEPT`` updates: a window's blocks, cached while it lasts, hold the states of its sites only, the environments there of the
side that the half sweep doesn't change, and that of the other side where the window begins. So an update reads a few sites of each
row and not all, and nothing else is kept. A window is made from the states by the tensors that the tasks carry, so lost
blocks are made again by Spark.

Where all states are so few that they make one partition, a whole sweep runs in the task that holds them
(``TaskHalfSweep``), one job for a sweep instead of one for an update.

Blocks are an RDD, since a gradient needs imperative work on arrays that a partition
keeps between jobs. Partitions are as many as there are cores, if their states take ``PARTITION_BYTES`` each, and more where they
would take more than ``MOST_BYTES``; blocks pass through a task one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.fitted import FittedEncoding, resolved
from chainloom.operators.mps import Chain
from chainloom.operators.prediction import states
from chainloom.operators.ranges import scaled_amplitudes

ROWS, KEPT, PARTITION_BYTES, MOST_BYTES, COLLECTED = 1024, 8, 4 << 20, 32 << 20, 64


def from_left(env: np.ndarray, phi: np.ndarray, t: np.ndarray) -> np.ndarray:
    l, d, r = t.shape
    return (env[:, :, None] * phi[:, None, :]).reshape(len(env), l * d) @ t.reshape(l * d, r)


def from_right(env: np.ndarray, phi: np.ndarray, t: np.ndarray) -> np.ndarray:
    l, d, r = t.shape
    return (phi[:, :, None] * env[:, None, :]).reshape(len(env), d * r) @ t.reshape(l, d * r).T


def scaled(env: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of greatest size 1, and the logarithm of what they have been divided by since the start."""
    size = np.abs(env).max(axis=1)
    size[size == 0] = 1
    return env / size[:, None], log + np.log(size)


def nothing(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.ones((n, 1), complex), np.zeros(n)


def moved_over(env: tuple, phi: np.ndarray, t: np.ndarray, to_left: bool) -> tuple:
    return scaled((from_right if to_left else from_left)(env[0], phi, t), env[1])


def state_blocks(series: DataFrame, encoding: str | FittedEncoding, d: int | None) -> RDD:
    """Cached (labels, conjugate states) of ``series`` (label, x), about ``ROWS`` rows each."""
    encoding = resolved(encoding, d)
    d, rows = encoding.d, states(series.select(F.col("label").cast("int").alias("label"), "x"), encoding, None, "label")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False) - 1j * b.column(2).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype(np.int32).tobytes()]), pa.array([flat.tobytes()])], names=["label", "phi"])

    def unpack(row) -> tuple[np.ndarray, np.ndarray]:
        label = np.frombuffer(bytes(row.label), np.int32)
        return label, np.frombuffer(bytes(row.phi), complex).reshape(len(label), -1, d)

    found = rows.mapInArrow(pack, "label binary, phi binary").rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    size = found.map(lambda b: b[1].nbytes).sum()
    cores = series.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, min(-(-size // PARTITION_BYTES), cores), -(-size // MOST_BYTES))
    wanted = wanted if wanted <= cores else -(-wanted // cores) * cores
    if wanted >= found.getNumPartitions():
        return found
    fewer = found.coalesce(wanted).persist(StorageLevel.MEMORY_AND_DISK)
    fewer.count()
    found.unpersist()
    return fewer


def environments(phi: np.ndarray, tensors: list, to_left: bool, first: int = 0) -> list[tuple]:
    """Of the side that a half sweep doesn't change, one (rows, logarithms) for each site, for those after ``first`` moves."""
    length, now = phi.shape[1], nothing(len(phi))
    found = [now] if not first else []
    for k in range(length - 2):
        j = k if to_left else length - 1 - k
        now = moved_over(now, phi[:, j], tensors[j], not to_left)
        if k + 1 >= first:
            found.append(now)
    return found


def summed(blocks: Iterator, bond: np.ndarray, j: int, to_left: bool, share: np.ndarray, loss_of: Callable) -> np.ndarray:
    """The loss, then the gradient's entries, summed over ``blocks``: label, phi, the fixed side's environments, the moving one.

    Outputs are mantissas times exp(log). A loss with a ``shift`` grows by shift * log where outputs grow, and its gradient
    doesn't depend on their scale, so it works on the mantissas; others get the outputs themselves.
    """
    l, s, t, r, c = bond.shape
    square, total = np.ascontiguousarray(bond).reshape(l * s, t * r * c), np.zeros(1 + bond.size, complex)
    for label, phi, fixed, moving in blocks:
        (left, a), (right, b) = (fixed[j], moving) if to_left else (moving, fixed[phi.shape[1] - 2 - j])
        n, log, shift = len(label), a + b, getattr(loss_of, "shift", None)
        p = (left[:, :, None] * phi[:, j, None, :]).reshape(n, l * s)
        q = (phi[:, j + 1, :, None] * right[:, None, :]).reshape(n, t * r)
        y = np.matmul(q[:, None, :], (p @ square).reshape(n, t * r, c))[:, 0]
        if shift is None:
            size = np.exp(log)
            each, weight = loss_of(y * size[:, None], label)
            weight = weight * size[:, None]
        else:
            each, weight = loss_of(y, label)
            each = each + shift * log
        total[0] += each @ share[label]
        weight = weight * share[label][:, None]
        gradient = total[1:].reshape(l * s, t * r, c)
        for k in range(c):
            rows = np.flatnonzero(weight[:, k])
            gradient[:, :, k] += (p[rows].conj() * weight[rows, k, None]).T @ q[rows].conj()
    return total


class TaskHalfSweep:
    """A half sweep within the one task that holds all blocks: what ``HalfSweep`` does with a job for each update."""

    def __init__(self, blocks: list, chain: Chain, to_left: bool):
        self.to_left, tensors = to_left, chain.tensors
        self.blocks = [[label, phi, environments(phi, tensors, to_left), nothing(len(phi))] for label, phi in blocks]

    def advance(self, j: int, tensor: np.ndarray) -> None:
        for b in self.blocks:
            b[3] = moved_over(b[3], b[1][:, j], tensor, self.to_left)

    def sums(self, bond: np.ndarray, j: int, share: np.ndarray, loss_of: Callable) -> np.ndarray:
        return summed(iter(self.blocks), bond, j, self.to_left, share, loss_of)

    def close(self) -> None:
        self.blocks = []


class HalfSweep:
    """The blocks of one half sweep over a chain; ``to_left``: bonds are updated from the right end on."""

    def __init__(self, base: RDD, chain: Chain, to_left: bool):
        self.base, self.to_left, self.length, self.news, self.done = base, to_left, chain.length, [], 0
        self.tensors = [None if j == chain.centre else t for j, t in enumerate(chain.tensors)]  # the centre is updated first
        self.window: RDD | None = None

    def _opened(self) -> RDD:
        """Blocks of the next ``KEPT`` updates, as a chain of their sites: label, phi, the fixed side's environments, the moving one."""
        to_left, tensors, length = self.to_left, list(self.tensors), self.length
        updates = min(KEPT, length - 1 - self.done)
        # sites of the window, and how many moves the fixed side is ahead at its last update
        self.low = low = length - 1 - self.done - updates if to_left else self.done
        fixed_from, past = low if to_left else length - 1 - (low + updates), range(length - 1, low + updates, -1) if to_left else range(low)

        def opened(block):
            label, phi = block
            moving, now = nothing(len(phi)), phi[:, : low + updates + 1] if to_left else phi[:, low:]
            for j in past:
                moving = moved_over(moving, phi[:, j], tensors[j], to_left)
            own = tensors[: low + updates + 1] if to_left else tensors[low:]
            fixed = environments(now, own, to_left, fixed_from)
            return label, np.ascontiguousarray(phi[:, low : low + updates + 1]), fixed, moving

        return self.base.map(opened).persist(StorageLevel.MEMORY_AND_DISK)

    def advance(self, j: int, tensor: np.ndarray) -> None:
        """Site ``j`` has got its tensor and belongs to the moving side from now on."""
        self.tensors[j] = tensor
        self.news.append((j - self.low if self.window else j, tensor))
        self.done += 1
        if self.window and len(self.news) == KEPT:
            self.close()
            self.news = []

    def sums(self, bond: np.ndarray, j: int, share: np.ndarray, loss_of: Callable) -> np.ndarray:
        """The loss, then the gradient's entries, summed over all series."""
        if self.window is None:
            self.window, self.news = self._opened(), []
        moved, to_left, at = _moved(self.news, self.to_left), self.to_left, j - self.low

        def run(blocks: Iterator) -> Iterator[np.ndarray]:
            yield summed(((*b[:3], moved(b)) for b in blocks), bond, at, to_left, share, loss_of)

        parts = self.window.mapPartitions(run)
        if parts.getNumPartitions() > COLLECTED:
            return parts.treeReduce(np.add, depth=2)
        return np.sum(parts.collect(), axis=0)  # one array of the bond's size for each partition

    def close(self) -> None:
        if self.window is not None:
            self.window.unpersist()
        self.window = None


def _moved(news: list[tuple[int, np.ndarray]], to_left: bool) -> Callable:
    news = list(news)

    def moved(block) -> tuple:
        env = block[3]
        for j, t in news:
            env = moved_over(env, block[1][:, j], t, to_left)
        return env

    return moved


def block_summary(base: RDD, chain: Chain) -> dict[str, float]:
    """Accuracy, mean -log weight of the true class, and mean squared error of the amplitudes' size."""

    def run(blocks: Iterator) -> Iterator[np.ndarray]:
        for label, phi in blocks:
            m, exponent = scaled_amplitudes(chain, phi.conj())
            rows, y = np.arange(len(label)), np.ldexp(np.abs(m), exponent[:, None])
            target = np.zeros_like(y)
            target[rows, label] = 1
            with np.errstate(divide="ignore"):
                kld = -2 * (np.log(np.abs(m[rows, label])) + exponent * np.log(2))
            yield np.array([len(label), (np.abs(m).argmax(axis=1) == label).sum(), kld.sum(), ((y - target) ** 2).sum() / 2])

    n, right, kld, mse = base.mapPartitions(lambda b: [sum(run(b), np.zeros(4))]).treeReduce(np.add, depth=2)
    return {"accuracy": float(right / n), "kld": float(kld / n), "mse": float(mse / n)} if n else {"accuracy": None, "kld": None, "mse": None}
