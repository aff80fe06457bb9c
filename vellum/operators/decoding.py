"""From class scores of frames to texts: best class, beams, collapsing, and scores of characters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.alphabet import NULL_CODE, Alphabet
from vellum.operators.ranking import CELL, before_cells, in_cells, same


def half(scores: Column) -> Column:
    """The first half of the classes; an odd number of them is an error."""
    n = F.size(scores)
    return F.when(n % 2 == 0, F.slice(scores, F.lit(1), (n / 2).cast("int"))).otherwise(F.raise_error(F.lit("odd number of classes")))


def best(scores: Column) -> Column:
    """(label, score) of a frame: the largest score, the first on ties."""
    top = F.array_max(scores)
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("label"), top.alias("score"))


def greedy(frames: Column, length: Column | None = None) -> Column:
    """array<(label, score)> of an array of frames, of the first `length` if given."""
    if length is not None:
        frames = F.slice(frames, F.lit(1), length)
    return F.transform(frames, best)


def greedy_frames(frames: DataFrame, keys: Sequence[str], scores: str = "logits") -> DataFrame:
    """Frame rows with label and score; nothing is exchanged."""
    return frames.select(*keys, best(F.col(scores)).alias("b")).select(*keys, "b.label", "b.score")


def runs(frames: DataFrame, sequence: Sequence[str], time: str, label: str = "label", rows: int | None = None) -> DataFrame:
    """Frames that begin a run of equal labels, and each frame's run number, in columns `starts` and `run`.

    A sequence of more than `rows` frames (ranking.ROWS) is cut into cells: runs are counted within each, and whether a cell begins with the label that the one
    before ended with, and how many runs came before, is added from a table of one row a cell.
    """
    cut = in_cells(frames, sequence, [time], rows)
    keys = [*sequence, CELL] if cut is not None else list(sequence)
    w = Window.partitionBy(*keys).orderBy(time)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True))
    if cut is None:
        return frames.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(so_far))
    inner = cut.withColumns({"starts": starts, "_first": F.row_number().over(w) == 1})
    inner = inner.withColumn("_inner", (F.col("starts") & ~F.col("_first")).cast("int"))
    cells = inner.groupBy(*keys).agg(F.min_by(label, time).alias("_head"), F.max_by(label, time).alias("_tail"), F.sum("_inner").alias("_n"))
    border = F.coalesce(F.col("_head") != F.lag("_tail").over(Window.partitionBy(*sequence).orderBy(CELL)), F.lit(True))
    cells = before_cells(cells.withColumn("_border", border), sequence, {"_before": F.sum(F.col("_n") + F.col("_border").cast("int"))})
    cells = cells.select(*keys, "_border", (F.coalesce("_before", F.lit(0)) + F.col("_border").cast("int")).alias("_before"))
    out = same(inner.withColumn("run", F.sum("_inner").over(so_far)), cells, keys)
    out = out.withColumns({"starts": F.when(F.col("_first"), F.col("_border")).otherwise(F.col("starts")), "run": F.col("run") + F.col("_before")})
    return out.select(*frames.columns, "starts", "run")


def ctc_scores(frames: DataFrame, sequence: Sequence[str], time: str, label: str = "label", score: str = "score", null: int = NULL_CODE, rows: int | None = None) -> DataFrame:
    """(sequence..., run, label, score): one row for each run of a label other than null, with its largest score."""
    return runs(frames, sequence, time, label, rows).filter(F.col(label) != null).groupBy(*sequence, "run").agg(F.first(label).alias("label"), F.max(score).alias("score"))


def ctc_labels(frames: DataFrame, sequence: Sequence[str], time: str, label: str = "label", null: int = NULL_CODE, rows: int | None = None) -> DataFrame:
    """Collapsed labels of each sequence as an array, in order of time."""
    kept = runs(frames, sequence, time, label, rows).filter(F.col("starts") & (F.col(label) != null))
    ordered = F.sort_array(F.collect_list(F.struct(time, label)))
    return kept.groupBy(*sequence).agg(F.transform(ordered, lambda x: x[label]).alias("labels"))


def predicted(rows: DataFrame, alphabet: Alphabet, frames: str = "frames", length: str | None = None, decoder: Callable[[Column, Column | None], Column] = greedy) -> DataFrame:
    """Adds prediction and scores (one for each character) to rows that hold their frames in an array.

    decoder: from the frames and their number, if given, to array<(label, score)>, one for each frame.
    """
    rows = rows.withColumn("_best", decoder(F.col(frames), F.col(length) if length else None))
    rows = rows.withColumn("_labels", F.transform("_best", lambda b: b["label"]))
    places = F.transform("_labels", lambda v, i: F.struct(v.alias("label"), i.alias("at")))
    # first and last frames of the runs, which stand in the same order; each run's frames are looked at once
    edge = lambda step: F.filter(places, lambda x: (x["label"] != NULL_CODE) & ~F.coalesce(F.get("_labels", x["at"] + step) == x["label"], F.lit(False)))
    highest = lambda a, b: F.array_max(F.transform(F.slice("_best", a["at"] + 1, b["at"] - a["at"] + 1), lambda f: f["score"].cast("double")))
    scores = F.zip_with(edge(-1), edge(1), highest)
    return rows.withColumn("prediction", alphabet.decode_ctc(F.col("_labels"))).withColumn("scores", scores).drop("_best", "_labels")


class Beams:
    """Prefix beam search over one frame after another.

    Prefixes are nodes of a trie, so a beam is a number, and equal prefixes are one whatever the frames they come from.  From time to time
    what all beams have in common is moved to `said`, and nodes that no beam leads to are dropped: the state is the labels and
    as much of the trie as the beams differ in, however many frames have passed.  Ties keep the smaller labels.
    """

    #: Nodes from which the trie is pruned.
    PRUNE = 4096

    def __init__(self, width: int = 3, null: int = NULL_CODE):
        self.width, self.null = width, null
        self.said: list[int] = []
        self.parent, self.label, self.child, self.limit = [-1], [-1], {}, self.PRUNE
        self.nodes, self.blank, self.value = [0], np.zeros(1), np.full(1, -np.inf)

    def prefix(self, node: int) -> list[int]:
        """Labels from the root of the trie."""
        out = []
        while self.parent[node] >= 0:
            out.append(self.label[node])
            node = self.parent[node]
        return out[::-1]

    def frame(self, logs: np.ndarray) -> None:
        """Takes the log probabilities of the classes."""
        row = np.arange(len(self.nodes))
        last = np.array([self.label[n] for n in self.nodes])
        both = np.logaddexp(self.blank, self.value)
        some = last >= 0
        kept = np.where(some, self.value + logs[last], -np.inf)
        grown = both[:, None] + logs
        grown[row[some], last[some]] = self.blank[some] + logs[last[some]]
        grown[:, self.null] = -np.inf
        place = {n: k for k, n in enumerate(self.nodes)}
        for k, n in enumerate(self.nodes):  # a beam that another one grows into
            if (p := place.get(self.parent[n])) is not None:
                kept[k] = np.logaddexp(kept[k], grown[p, last[k]])
                grown[p, last[k]] = -np.inf
        blank = both + logs[self.null]
        total = np.concatenate([np.logaddexp(blank, kept), grown.ravel()])
        best = self._best(total)
        classes, n = len(logs), len(self.nodes)
        nodes = [self.nodes[k] if k < n else self._grown(self.nodes[(k - n) // classes], (k - n) % classes) for k in best]
        best = np.array(best)
        stays = best < n
        self.blank = np.where(stays, blank[np.minimum(best, n - 1)], -np.inf)
        self.value = np.where(stays, kept[np.minimum(best, n - 1)], total[best])
        self.nodes = nodes
        if len(self.parent) > self.limit:
            self._prune()

    def _best(self, total: np.ndarray) -> list[int]:
        """The places of the largest totals in order, equal ones by their labels."""
        width = min(self.width, int(np.count_nonzero(total > -np.inf)))
        if not width:
            return list(range(len(self.nodes)))
        least = -np.partition(-total, width - 1)[width - 1]
        found = np.flatnonzero(total >= least)
        found = found[np.argsort(-total[found], kind="stable")]
        if (np.diff(total[found]) == 0).any():
            n, classes = len(self.nodes), (len(total) - len(self.nodes)) // len(self.nodes)
            labels = lambda k: self.prefix(self.nodes[k]) if k < n else [*self.prefix(self.nodes[(k - n) // classes]), (k - n) % classes]
            return sorted(found.tolist(), key=lambda k: (-total[k], labels(k)))[:width]
        return found[:width].tolist()

    def _grown(self, node: int, label: int) -> int:
        if (node, label) not in self.child:
            self.child[node, label] = len(self.parent)
            self.parent.append(node), self.label.append(label)
        return self.child[node, label]

    def _prune(self) -> None:
        paths = []
        for n in self.nodes:
            path = [n]
            while self.parent[path[-1]] >= 0:
                path.append(self.parent[path[-1]])
            paths.append(path[::-1])
        depth = 0
        while all(len(p) > depth + 1 and p[depth + 1] == paths[0][depth + 1] for p in paths):
            depth += 1
        self.said += [self.label[n] for n in paths[0][1 : depth + 1]]
        parent, label, number = [-1], [self.label[paths[0][depth]]], {paths[0][depth]: 0}
        for p in paths:
            for n in p[depth + 1 :]:
                if n not in number:
                    number[n] = len(parent)
                    parent.append(number[self.parent[n]]), label.append(self.label[n])
        self.nodes = [number[n] for n in self.nodes]
        self.parent, self.label = parent, label
        self.child = {(p, x): k for k, (p, x) in enumerate(zip(parent, label, strict=True)) if k}
        self.limit = self.PRUNE + 2 * len(parent)

    def result(self) -> tuple[list[int], float]:
        return [*self.said, *self.prefix(self.nodes[0])], float(np.logaddexp(self.blank[0], self.value[0]))


def beam(probabilities: np.ndarray, width: int = 3, null: int = NULL_CODE) -> tuple[list[int], float]:
    """Prefix beam search over (time, classes): the most probable collapsed labels among the prefixes kept, and their log probability."""
    beams = Beams(width, null)
    with np.errstate(divide="ignore"):
        logs = np.log(np.asarray(probabilities, float))
    for frame in logs:
        beams.frame(frame)
    return beams.result()


def beam_decoded(frames: DataFrame, sequence: Sequence[str], time: str, scores: str = "logits", width: int = 3, softmax: bool = True) -> DataFrame:
    """(sequence..., labels, log_p) by beam search.

    Frames stream through a task in order, with one sequence's beams as the state that goes from one batch to the next, so that
    a sequence may be longer than memory.
    """
    schema = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in sequence) + ", labels array<int>, log_p double"

    def run(batches):
        now, beams = None, None

        def ended():
            labels, p = beams.result()
            columns = [pa.array([v], kinds[c]) for c, v in zip(sequence, now, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([labels], pa.list_(pa.int32())), pa.array([p])], [*sequence, "labels", "log_p"])

        kinds = {}
        for batch in batches:
            kinds = kinds or {c: batch.schema.field(c).type for c in sequence}
            column = batch.column("_scores")
            values, at = column.values.to_numpy(False), column.offsets.to_numpy(False)
            keys = list(zip(*(batch.column(c).to_pylist() for c in sequence), strict=True))
            for k, key in enumerate(keys):
                if key != now:
                    if beams is not None:
                        yield ended()
                    now, beams = key, Beams(width)
                x = values[at[k] : at[k + 1]]
                with np.errstate(divide="ignore"):
                    beams.frame(x - x.max() - np.log(np.exp(x - x.max()).sum()) if softmax else np.log(x))
        if beams is not None:
            yield ended()

    rows = frames.select(*sequence, time, F.col(scores).cast("array<double>").alias("_scores"))
    return rows.repartition(*sequence).sortWithinPartitions(*sequence, time).mapInArrow(run, schema)
