"""Secret scan: fixed formats plus grammar inference over what they find.

Base spans come from three fixed patterns. Their values are labelled credentials: per kind Spark
counts the prefix tree of all distinct values, whose statistically compatible states are merged (Hoeffding
tests on symbol and stop frequencies, the state-merging scheme of stochastic regular inference) into a
probabilistic automaton. The rest of every text gives candidates: whole tokens and, where these do not fit,
their parts between separators. They are scored by their log-likelihood per character under the automata
against uniform characters; those that fit a format as well as equally long beginnings of the
labelled credentials do are added as spans of kind ``grammar``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.common import small_batches

BASE_KINDS = ("assign", "access", "hex")
ADDED_KIND = "grammar"
TREE_NODES = 20_000  # prefixes of a kind that may become states; rarer ones, also counted, go on in the state they reach
VALUE_CHARS = 200    # of each value; a longer one counts as going on
SCORE_BINS = 1024    # bins that a score's unit is counted in before the quantile is picked from one of them
MERGE_ALPHA = 0.05   # significance of the compatibility tests
UNSEEN = 1e-4        # probability of a symbol that a state never saw
ALPHABET = 64        # characters of the uniform background
QUANTILE = 0.02      # labelled credentials that may score below the threshold of their kind
LEAST_CHARS = 8      # of a value after a name, and of any other candidate if labelled values are as short
LONG_CHARS = 16      # from here on candidates are scored whatever the lengths of the labelled values
SEPARATORS = ("=", "/", "+_-")  # a candidate that does not fit is split at these, one level after the other

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
# Access keys of 16 and hex of 32 characters lie inside runs of these characters.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}")
_BEFORE_VALUE = re.compile(r"""(?:=\x20*|:)["']?\Z""")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
_SPAN = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))


def base_spans(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int]]]:
    """(start, kind index, end, value) of the fixed formats in order, and all long runs."""
    found = []
    lowered = text.encode("utf-8", "surrogatepass").lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs = [m.span() for m in _RUN.finditer(text)]
    for a, b in runs:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text, a, b) if len(m[0]) >= 16]
        if b - a >= 32:
            found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text, a, b) if len(m[0]) >= 32]
    return sorted(found), runs


def candidates(text: str, base: list) -> list[tuple[int, int]]:
    """What the base spans leave of the runs, from ``LEAST_CHARS`` characters on."""
    out = []
    at, spans = 0, [(s, e) for s, _, e, _ in base]
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        i = at
        while i < len(spans) and spans[i][0] < b:
            if a < spans[i][0]:
                out.append((a, spans[i][0]))
            a = max(a, spans[i][1])
            i += 1
        if a < b:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= LEAST_CHARS]


def is_value(text: str, start: int) -> bool:
    """Whether an equals sign or colon, and perhaps a quote, stand before ``start``."""
    return _BEFORE_VALUE.search(text, max(0, start - 8), start) is not None


def grammar_spans(text: str, base: list, model: SecretModel) -> list[tuple[int, int]]:
    """The candidates, or the largest of their parts, that fit a learned format."""
    out = []
    todo = [(a, b, 0) for a, b in candidates(text, base)] if model.automata else []
    while todo:
        a, b, level = todo.pop()
        word = text[a:b]
        value = is_value(text, a)
        # All digits are a number, short or bare letters a word, whatever the formats learned.
        if _LETTER.search(word) and (_DIGIT.search(word) or value and b - a >= LONG_CHARS) and model.fits(word, value):
            out.append((a, b))
        elif level < len(SEPARATORS):
            at = a
            for part in re.split(f"[{SEPARATORS[level]}]", word):
                if len(part) >= LEAST_CHARS:
                    todo.append((at, at + len(part), level + 1))
                at += len(part) + 1
    return out


@dataclass
class Automaton:
    """States 0..n-1: how often each was passed and ended in, and its moves {symbol: [count, state]}."""

    passed: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    rare: list[int] = field(default_factory=lambda: [0])  # passes that go on by moves too rare to be in the tree

    def add(self, word: str, ends: bool = True) -> None:
        state = 0
        self.passed[0] += 1
        for c in word:
            move = self.moves[state].get(c)
            if move is None:
                move = self.moves[state][c] = [0, len(self.moves)]
                self.passed.append(0)
                self.ended.append(0)
                self.moves.append({})
                self.rare.append(0)
            move[0] += 1
            state = move[1]
            self.passed[state] += 1
        self.ended[state] += ends

    def score(self, word: str) -> float:
        """Log-likelihood ratio per character against uniform characters."""
        return self.scores(word, [len(word)])[0]

    def scores(self, word: str, lengths: list[int]) -> list[float]:
        """The scores of the word's beginnings of these rising lengths, up to its own."""
        state, total, out = 0, 0.0, []
        due = iter(lengths)
        length = next(due, None)
        for i, c in enumerate(word):
            if i == length:
                out.append(total / max(1, i) + math.log(ALPHABET))
                length = next(due, None)
            n = self.passed[state]
            move = self.moves[state].get(c)
            if move is None:
                total += math.log(UNSEEN)
            else:
                total += math.log(max(UNSEEN, move[0] / n))
                state = move[1]
        if length == len(word):
            out.append(total / max(1, length) + math.log(ALPHABET))
        return out

    def states(self, word: str) -> list[int]:
        """The states along the word; a move that the automaton lacks stays where it is."""
        out = [0]
        for c in word:
            move = self.moves[out[-1]].get(c)
            out.append(move[1] if move else out[-1])
        return out


def infer(words: list[str], alpha: float = MERGE_ALPHA, longest: int | None = None) -> Automaton:
    """Prefix tree of the words with compatible states merged, from the root on; words over ``longest`` are cut there and do not end."""
    a = Automaton()
    for w in words:
        a.add(w[:longest], longest is None or len(w) <= longest)
    return merged(a, alpha)


def merged(a: Automaton, alpha: float = MERGE_ALPHA) -> Automaton:
    """The prefix tree ``a`` with compatible states merged; what its rare moves may hide counts as no difference."""
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1, n1, f2, n2, hidden=0.0):
        return abs(f1 / n1 - f2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2)) + hidden

    def compatible(x, y):
        todo = [(x, y)]
        while todo:
            p, q = todo.pop()
            n1, n2 = a.passed[p], a.passed[q]
            if differ(a.ended[p], n1, a.ended[q], n2):
                return False
            for c in a.moves[p].keys() | a.moves[q].keys():
                m1, m2 = a.moves[p].get(c), a.moves[q].get(c)
                if differ(m1[0] if m1 else 0, n1, m2[0] if m2 else 0, n2, a.rare[p] / n1 + a.rare[q] / n2):
                    return False
                if m1 and m2:
                    todo.append((m1[1], m2[1]))
        return True

    def fold(into, tree):
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            a.passed[p] += a.passed[q]
            a.ended[p] += a.ended[q]
            a.rare[p] += a.rare[q]
            for c, (n, to) in a.moves[q].items():
                if c in a.moves[p]:
                    a.moves[p][c][0] += n
                    todo.append((a.moves[p][c][1], to))
                else:
                    a.moves[p][c] = [n, to]

    red, blue = [0], deque((0, c) for c in sorted(a.moves[0]))
    settled = {0}
    while blue:
        state, c = blue.popleft()
        to = a.moves[state][c][1]
        if to in settled:
            continue
        # Rare states are compatible with most: the state they hang on comes first, then the newest.
        match = next((r for r in [state, *reversed(red)] if compatible(r, to)), None)
        if match is None:
            red.append(to)
            settled.add(to)
            blue.extend((to, x) for x in sorted(a.moves[to]))
        else:
            a.moves[state][c][1] = match
            fold(match, to)
            for r in red:  # folding can hang new subtrees on settled states
                blue.extend((r, x) for x, (_, nxt) in sorted(a.moves[r].items()) if nxt not in settled)
    return a


def _walk_tree(words: Iterator[str]) -> Iterator[tuple[int, int, str, int, int]]:
    """(node, parent, symbol, whether a word ends, whether one is cut) of every prefix; nodes are 63-bit hashes, the root's is 0."""
    for w in words:
        node, last = 0, min(len(w), VALUE_CHARS) - 1
        yield 0, -1, "", 0, 0
        for i, c in enumerate(w[:VALUE_CHARS]):
            parent, node = node, ((node ^ node >> 29) * 0x5851F42D4C957F2D + ord(c) + 1) & 0x7FFFFFFFFFFFFFFF
            yield node, parent, c, int(i == last and len(w) <= VALUE_CHARS), int(i == last and len(w) > VALUE_CHARS)


def prefix_counts(values: DataFrame) -> DataFrame:
    """(kind, node, parent, symbol, n, ended, cut): how many of all values pass every prefix, end there or are cut there."""
    schema = "kind int, node long, parent long, symbol string, n long, ended long, cut long"
    names = ["kind", "node", "parent", "symbol", "n", "ended", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = Counter()
                for kind, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for node, parent, c, ended, cut in _walk_tree([value]):
                        found[kind, node, parent, c, 0] += 1
                        found[kind, node, parent, c, 1] += ended
                        found[kind, node, parent, c, 2] += cut
                keys = [k[:4] for k in found if k[4] == 0]
                rows = [(*k, found[(*k, 0)], found[(*k, 1)], found[(*k, 2)]) for k in keys]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([
                    (x, pa.int32() if x == "kind" else pa.string() if x == "symbol" else pa.int64()) for x in names]))

    return values.mapInArrow(run, schema).groupBy("kind", "node", "parent", "symbol").agg(*[F.sum(x).alias(x) for x in ("n", "ended", "cut")])


def tree_of(nodes: list) -> Automaton:
    """The prefix tree of rows of ``prefix_counts``, with a root and every kept node's parent among them."""
    below: dict[int, list] = {}
    for r in sorted(nodes, key=lambda r: r["symbol"]):
        below.setdefault(r["parent"], []).append(r)
    a = Automaton([], [], [], [])
    todo = deque((r, None) for r in below[-1])
    while todo:
        r, move = todo.popleft()
        state = len(a.moves)
        if move is not None:
            move[1] = state
        own = below.get(r["node"], [])
        a.passed.append(r["n"])
        a.ended.append(r["ended"])
        a.rare.append(r["n"] - r["ended"] - r["cut"] - sum(x["n"] for x in own))
        a.moves.append({x["symbol"]: [x["n"], -1] for x in own})
        todo.extend((x, a.moves[state][x["symbol"]]) for x in own)
    return a


def recounted(automata: dict[int, Automaton], values: DataFrame) -> dict[int, Automaton]:
    """The automata with all values' passes counted, those by rare moves included: these stay in their state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for b in batches:
            for kind, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if kind in automata:
                    states = automata[kind].states(value[:VALUE_CHARS])
                    found.update((kind, s, c, to) for s, c, to in zip(states, value[:VALUE_CHARS], states[1:]))
                    found[kind, states[-1], "" if len(value) <= VALUE_CHARS else "cut", -1] += 1
        columns = list(zip(*[(*k, n) for k, n in found.items()])) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 2 else pa.int64()) for i, x in enumerate(columns)],
                                         ["kind", "state", "symbol", "next", "n"])

    out = {k: Automaton(*([0] * len(a.moves) for _ in range(2)), [{} for _ in a.moves], [0] * len(a.moves)) for k, a in automata.items()}
    rows = values.mapInArrow(run, "kind long, state long, symbol string, next long, n long").groupBy("kind", "state", "symbol", "next").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # states by symbols at most
        a = out[r["kind"]]
        a.passed[r["state"]] += r["n"]
        if r["next"] >= 0:
            a.moves[r["state"]][r["symbol"]] = [r["n"], r["next"]]
        elif not r["symbol"]:
            a.ended[r["state"]] += r["n"]
    return out


def threshold_lengths(longest: int) -> list[int]:
    out, length = [], LEAST_CHARS
    while length <= longest:
        out.append(length)
        length += max(1, length // 4)
    return out


def thresholds(automata: dict[int, Automaton], values: DataFrame) -> dict[int, list[tuple[int, float]]]:
    """By kind (length, least score) with lengths rising: the ``QUANTILE`` of all values' beginnings of that length.

    Scores are counted in bins; the driver sees these counts, and one bin of a length is ordered.
    """
    lengths = threshold_lengths(VALUE_CHARS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, x) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, x in zip(lengths, automata[k].scores(v, lengths))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))],
                                             ["kind", "length", "score"])

    scores = values.mapInArrow(run, "kind int, length int, score double").withColumn("bin", F.floor(F.col("score") * SCORE_BINS)) \
        .groupBy("kind", "length", "bin", "score").agg(F.count(F.lit(1)).alias("n")).persist()
    bins: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in scores.groupBy("kind", "length", "bin").agg(F.sum("n").alias("n")).collect():
        bins.setdefault((r["kind"], r["length"]), []).append((r["bin"], r["n"]))
    picks = []
    for key, counted in bins.items():
        rank = int(QUANTILE * sum(n for _, n in counted))
        for x, n in sorted(counted):
            if rank < n:
                picks.append((*key, x, rank))
                break
            rank -= n
    out: dict[int, list[tuple[int, float]]] = {k: [] for k in automata}
    if picks:
        picked = values.sparkSession.createDataFrame(picks, "kind int, length int, bin long, rank long")
        before = F.sum("n").over(Window.partitionBy("kind", "length").orderBy("score"))
        at = scores.join(F.broadcast(picked), ["kind", "length", "bin"]).withColumn("upto", before).where(F.col("upto") > F.col("rank"))
        for r in at.groupBy("kind", "length").agg(F.min("score").alias("score")).orderBy("length").collect():
            out[r["kind"]].append((r["length"], r["score"]))
    scores.unpersist()
    return out


@dataclass
class SecretModel:
    automata: list[tuple[Automaton, list[tuple[int, float]], int]]  # with thresholds by length, and the least length of bare candidates

    def fits(self, word: str, value: bool = False) -> bool:
        """``value``: the word follows a name, so that any length from ``LEAST_CHARS`` on will do."""
        for a, least, shortest in self.automata:
            if len(word) >= (LEAST_CHARS if value else shortest):
                i = bisect_right(least, len(word), key=lambda x: x[0]) - 1
                if i >= 0 and a.score(word) >= least[i][1]:
                    return True
        return False


def fit_secrets(docs: DataFrame, text_col: str = "text") -> SecretModel:
    """Learn the formats of the base spans of all texts: counts, states and thresholds from all distinct values of a kind.

    The driver gets prefixes passed by at least a power of two of values, the least with which they are ``TREE_NODES`` at most,
    and merges them. If rarer ones remain, all values walk through the automaton for its counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, v[:VALUE_CHARS + 1]) for t in b.column(0).to_pylist() if t for _, k, _, v in base_spans(t)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.string())], ["kind", "value"])

    values = small_batches(docs).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind int, value string").distinct().persist()
    lengths: dict[int, list[tuple[int, int]]] = {}
    for r in values.groupBy("kind", F.length("value").alias("chars")).agg(F.count(F.lit(1)).alias("n")).orderBy("chars").collect():
        lengths.setdefault(r["kind"], []).append((r["chars"], r["n"]))
    if not lengths:
        values.unpersist()
        return SecretModel([])
    tree = prefix_counts(values).persist()
    sizes: dict[int, Counter] = {}
    power = F.length(F.bin("n")) - 1
    for r in tree.groupBy("kind", power.alias("power")).agg(F.count(F.lit(1)).alias("nodes")).collect():
        sizes.setdefault(r["kind"], Counter())[r["power"]] += r["nodes"]
    least = {k: next(p for p in range(64) if sum(n for x, n in c.items() if x >= p) <= TREE_NODES) for k, c in sizes.items()}
    automata = {k: merged(tree_of(tree.where((F.col("kind") == k) & (F.col("n") >= 1 << p)).collect())) for k, p in sorted(least.items())}
    tree.unpersist()
    if any(least.values()):
        automata |= recounted({k: automata[k] for k, p in least.items() if p}, values)
    floors = thresholds(automata, values)
    values.unpersist()
    return SecretModel([(a, floors[k], max(LEAST_CHARS, min(LONG_CHARS, _at_quantile(lengths[k])))) for k, a in automata.items()])


def _at_quantile(counted: list[tuple[int, int]]) -> int:
    """The ``QUANTILE`` of values given in order with their counts."""
    rank = int(QUANTILE * sum(n for _, n in counted))
    for x, n in counted:
        if rank < n:
            return x
        rank -= n
    raise ValueError("no values")


def spans_of(text: str | None, model: SecretModel) -> list[dict]:
    """All spans of a whole text, by start, then kind; null: none."""
    if not text:
        return []
    base, _ = base_spans(text)
    out = [(s, k, e) for s, k, e, _ in base]
    out += [(a, len(BASE_KINDS), b) for a, b in grammar_spans(text, base, model)]
    names = (*BASE_KINDS, ADDED_KIND)
    return [{"kind": names[k], "start": s, "end": e} for s, k, e in sorted(out)]


def redacted(text: str, spans: list[dict], mark: str) -> str:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s in spans:
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"]])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text", spans_col: str = "secret_spans",
                 redact: str | None = None) -> DataFrame:
    """``docs`` with its secret spans (replacing such a column); code points, end exclusive.

    With ``redact`` every span in the text is replaced by that string. Null and empty texts have no
    spans. Rows and other columns are kept; an empty table gives an empty result.
    """
    kept = [f for f in docs.schema if f.name != spans_col]
    schema = T.StructType([*kept, T.StructField(spans_col, _SPAN)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            found = [spans_of(t, model) for t in texts]
            columns = {f.name: b.column(f.name) for f in kept}
            if redact is not None:
                columns[text_col] = pa.array([redacted(t, s, redact) if s else t for t, s in zip(texts, found)], columns[text_col].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found, arrow)], [f.name for f in schema])

    return small_batches(docs).select(*[F.col(f.name) for f in kept]).mapInArrow(run, schema)
