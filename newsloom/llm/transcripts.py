"""Op 6. Transcripts to chat turns: roles by a hidden Markov model over lines."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
STATES = tuple((role, first) for role in ROLES for first in (True, False))
MARKER = re.compile(r"\s{0,3}[\[(*]{0,2}([^\W\d_][\w ]{0,20}?)[\])*]{0,2}\s{0,2}[:>]\s?")
MARKERS = 500        # of the most frequent marker words are known to a model
PART_TURNS = 256     # turns of one conversation that are read as one transcript
# How speakers are named in made-up transcripts, by style.
STYLES = ({"system": "System", "user": "User", "assistant": "Assistant"},
          {"system": "Instructions", "user": "Human", "assistant": "AI"},
          {"system": "System", "user": "Customer", "assistant": "Agent"},
          {"system": "Setup", "user": "Q", "assistant": "A"})


def observe(line: str) -> tuple[str, int, int]:
    """(marker word or '', length by powers of two, ending) of a line."""
    found = MARKER.match(line)
    text = line.rstrip()
    ending = 0 if not text else 1 if text.endswith("?") else 2 if text[-1] in ".!:" else 3
    return found.group(1).lower() if found else "", min(12, len(text).bit_length()), ending


@dataclass
class RoleModel:
    """Log-probabilities of starts, moves and each feature's values by state."""

    start: np.ndarray = field(default_factory=lambda: np.zeros(6))
    inner_start: np.ndarray = field(default_factory=lambda: np.zeros(6))
    move: np.ndarray = field(default_factory=lambda: np.zeros((6, 6)))
    markers: dict[str, np.ndarray] = field(default_factory=dict)
    lengths: np.ndarray = field(default_factory=lambda: np.zeros((13, 6)))
    endings: np.ndarray = field(default_factory=lambda: np.zeros((4, 6)))

    def decode(self, lines: list[str], inner: bool) -> list[int]:
        """The likeliest states (Viterbi); ``inner``: the lines do not begin a conversation."""
        best = self.inner_start if inner else self.start
        back = []
        for k, line in enumerate(lines):
            marker, length, ending = observe(line)
            seen = (self.markers.get(marker, self.markers["?"]) + self.lengths[length]
                    + self.endings[ending])
            if k:
                paths = best[:, None] + self.move
                back.append(paths.argmax(axis=0))
                best = paths.max(axis=0)
            best = best + seen
        states = [int(best.argmax())]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        return states[::-1]


def fit_counts(counts: list[tuple[str, str, int, int]]) -> RoleModel:
    """A model from (kind, value, state, number) with one added to each count."""
    table: dict[str, Counter] = {k: Counter() for k in ("start", "move", "marker", "length", "end")}
    for kind, value, state, n in counts:
        table[kind][value, state] += n
    allowed = np.array([[b[1] or a[0] == b[0] for b in STATES] for a in STATES])
    first = np.array([s[1] for s in STATES])

    def logs(matrix, axis):
        with np.errstate(divide="ignore"):
            return np.log(matrix / matrix.sum(axis=axis, keepdims=True))

    model = RoleModel()
    start = np.array([table["start"]["0", s] + 1.0 for s in range(6)]) * first
    model.start = logs(start, 0)
    model.inner_start = np.where(first, model.start, -2.0)
    model.move = logs(np.array([[table["move"][str(a), b] + 1.0 for b in range(6)]
                                for a in range(6)]) * allowed, 1)
    model.lengths = logs(np.array([[table["length"][str(v), s] + 1.0 for s in range(6)]
                                   for v in range(13)]), 0)
    model.endings = logs(np.array([[table["end"][str(v), s] + 1.0 for s in range(6)]
                                   for v in range(4)]), 0)
    totals = Counter()
    for (value, _), n in table["marker"].items():
        totals[value] += n
    known = ["", "?", *[m for m, _ in totals.most_common(MARKERS) if m not in ("", "?")]]
    matrix = logs(np.array([[table["marker"][m, s] + 0.5 for s in range(6)] for m in known]), 0)
    model.markers = dict(zip(known, matrix))
    return model


def as_transcripts(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """Transcripts made of conversations: (conv_id, part, lines, truth).

    A part is ``PART_TURNS`` turns of a conversation, so no group grows with a conversation's
    length. Speakers are named in one of four styles by a hash of the conversation's id; every
    fourth turn, by a hash, has no marker. ``truth`` has each line's state (null without a known
    role). Turns are ordered by (turn, role, text); a row that is repeated counts once. A null turn
    is in part 0, before the others; a null text is one empty line.
    """
    number = F.coalesce(F.col(turn), F.lit(-1)).cast("long")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.greatest(F.lit(0).cast("long"), F.floor(number / PART_TURNS)).alias("part"),
        F.struct(number.alias("turn"), F.lower(F.trim(role)).alias("role"),
                 F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    style = F.pmod(F.xxhash64(F.col("conv_id"), F.lit(1)), F.lit(len(STYLES)))

    def name(r: Column) -> Column:
        out = F.lit("Speaker")
        for k, names in enumerate(STYLES):
            for known, word in names.items():
                out = F.when((style == k) & (r == known), word).otherwise(out)
        return out

    def lines(t):
        marked = F.pmod(F.xxhash64(F.col("conv_id"), t["turn"], F.lit(2)), F.lit(4)) != 0
        return F.transform(F.split(t["text"], "\n"), lambda x, i: F.when(
            (i == 0) & marked, F.concat(name(t["role"]), F.lit(": "), x)).otherwise(x))

    def truth(t):
        known = F.array_position(F.array(*[F.lit(r) for r in ROLES]), t["role"])
        return F.transform(F.split(t["text"], "\n"), lambda x, i: F.when(
            known > 0, 2 * (known - 1) + F.when(i == 0, 0).otherwise(1)).cast("int"))

    return grouped.select("conv_id", "part", F.flatten(F.transform("turns", lines)).alias("lines"),
                          F.flatten(F.transform("turns", truth)).alias("truth"))


def held_out(conv_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(conv_id).cast("string")) % 3 == 1, F.lit(False))


def fit(transcripts: DataFrame) -> RoleModel:
    """A model from all transcripts with truth that are not held out, by counts.

    Tasks count by themselves; what reaches the driver are sums over states and feature values, of
    marker words the ``MARKERS`` most frequent ones.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for part, lines, truth in zip(*(batch.column(k).to_pylist() for k in range(3))):
                previous = None
                for k, (line, state) in enumerate(zip(lines, truth)):
                    if state is None:
                        previous = None
                        continue
                    marker, length, ending = observe(line)
                    found["marker", marker, state] += 1
                    found["length", str(length), state] += 1
                    found["end", str(ending), state] += 1
                    if previous is not None:
                        found["move", str(previous), state] += 1
                    elif k == 0 and part == 0:
                        found["start", "0", state] += 1
                    previous = state
            yield pa.RecordBatch.from_arrays([
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.string()),
                pa.array([f[2] for f in found], pa.int32()),
                pa.array(list(found.values()), pa.int64())], ["kind", "value", "state", "n"])

    counts = transcripts.filter(~held_out("conv_id")).select("part", "lines", "truth").mapInArrow(
        count, "kind string, value string, state int, n long").groupBy(
        "kind", "value", "state").agg(F.sum("n").alias("n"))
    common = counts.filter("kind <> 'marker'").collect()  # states by feature values
    markers = counts.filter("kind = 'marker'").orderBy(F.desc("n"), "value", "state").limit(
        6 * MARKERS).collect()
    return fit_counts([tuple(r) for r in common + markers])


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: each turn's role on a line of its own, its text, an end mark."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def turns_of(lines: list[str], states: list[int], model: RoleModel) -> list[tuple[str, str]]:
    """(role, text) of each turn; known markers at a turn's beginning go."""
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states):
        role, first = STATES[state]
        if first or not out:
            marker = observe(line)[0]
            if marker and marker in model.markers:
                line = line[MARKER.match(line).end():]
            out.append((role, [line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(text)) for role, text in out]


def parse(transcripts: DataFrame, model: RoleModel, with_text: bool = True) -> DataFrame:
    """(conv_id, part, held_out, n_lines, n_right, n_turns, roles, rendered_sha256[, rendered]).

    Each part's lines get their likeliest states; turns begin at first lines. ``n_right`` counts
    the lines whose state is the true one. The model has a fixed size and is broadcast. Null ids
    stay. An empty table gives no rows.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    columns = ["conv_id", "part", "held_out", "n_lines", "n_right", "n_turns", "roles",
               "rendered_sha256"] + ["rendered"] * with_text

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for part, lines, truth in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4))):
                states = known.decode(lines, part > 0)
                turns = turns_of(lines, states, known)
                text = render(turns)
                rows.append((len(lines), sum(a == b for a, b in zip(states, truth)), len(turns),
                             ",".join(r for r, _ in turns),
                             hashlib.sha256(text.encode()).hexdigest(), text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2)]
                + [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                + [pa.array([r[k] for r in rows], pa.string()) for k in range(3, 5 + with_text)],
                columns)

    kind = transcripts.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, part long, held_out boolean, n_lines long, n_right long, "
              "n_turns long, roles string, rendered_sha256 string" + ", rendered string" * with_text)
    return transcripts.select("conv_id", "part", held_out("conv_id").alias("held_out"), "lines",
                              "truth").mapInArrow(parsed, schema)
