"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
STATES = ("other", *KINDS)
#: The labelled table: so many documents with digits or @, the first by a hash of doc_id.
SAMPLE_ROWS = 1500

_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@+][^\x20\x09-\x0D]*")
_BLANK = frozenset(" \t\n\x0b\x0c\r")


def _emails(text: str):
    """Matches are found from their @, so a long run of local characters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            done = at + 1 if start == at else max(done, start)
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; ends exclusive, in code points."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


#: Runs of a word up to which its shape tells their order.
SHAPE_RUNS = 24


def shape(token: str) -> str:
    """Letters, capitals and digits of a word as x, X and d, runs as one, with the digits counted.  Of a
    word with many runs only the signs that occur are told, so that there are not too many shapes."""
    kinds, digits, last = [], 0, ""
    for c in token:
        k = "d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isalpha() else c
        digits += k == "d"
        if k != last:
            kinds.append(k)
            last = k
    size = 0 if not digits else 1 if digits < 4 else 2 if digits < 9 else 3 if digits < 12 else 4 if digits < 20 else 5
    body = "".join(kinds) if len(kinds) <= SHAPE_RUNS else "~" + "".join(sorted(set(kinds)))
    return body.rstrip(".,;:!?") + str(size)


PLAIN = "w"
GAP = 2


def chains(text: str) -> list[list[tuple[int, int, str]]]:
    """The chains of a text: words that hold a digit, @ or +, as (start, end, shape), with the plain
    words around and between them.  More than GAP plain words in a row end a chain; a word without
    such a character has no other feature than being plain, and is 'other' outside any chain."""
    out: list[list[tuple[int, int, str]]] = []
    end = 0
    for m in _MARK.finditer(text):
        start = m.start()
        while start > end and text[start - 1] not in _BLANK:
            start -= 1
        between = len(text[end:start].split(None, GAP + 1)) if out or start else 0
        plain = [(start, start, PLAIN)] * min(between, GAP)
        if not out or between > GAP:
            if out:
                out[-1].append((end, end, PLAIN))
            out.append(plain[:1])
        else:
            out[-1] += plain
        token = text[start : m.end()]
        out[-1].append((start, m.end(), shape(token)))
        end = m.end()
    if out and text[end : end + 1]:
        out[-1].append((end, end, PLAIN))
    return out


def tags(chain: list[tuple[int, int, str]], spans: list[tuple[int, int, int]]) -> list[int]:
    """State of each word of a chain: the kind of a span that it overlaps, else 0."""
    out = []
    for start, end, _ in chain:
        out.append(next((k + 1 for a, k, b in spans if a < end and start < b), 0))
    return out


@dataclass
class ShapeField:
    """Scores of states given a word's shape and its neighbours' shapes, and of state changes."""

    names: dict[str, int]
    weights: np.ndarray  # features x states
    moves: np.ndarray  # states x states, first row set apart below
    begin: np.ndarray

    def ids(self, chain) -> np.ndarray:
        """Three features of each word; 0 stands for shapes that the labelled table lacks."""
        shapes = ["^", *(s for *_, s in chain), "$"]
        get = self.names.get
        return np.array([
            [get("=" + shapes[i], 0), get("<" + shapes[i - 1], 0), get(">" + shapes[i + 1], 0)]
            for i in range(1, len(shapes) - 1)
        ], dtype=np.int64).reshape(-1, 3)


def _batches(all_ids: list[np.ndarray], cells: int = 1 << 18):
    """Indices of chains of like length, padded together."""
    order = sorted(range(len(all_ids)), key=lambda i: len(all_ids[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(all_ids[order[stop]]) <= cells and len(
            all_ids[order[stop]]
        ) <= 2 * len(all_ids[order[at]]) + 2:
            stop += 1
        part = order[at:stop]
        longest = max(len(all_ids[i]) for i in part)
        ids = np.zeros((len(part), longest, 3), dtype=np.int64)
        for row, i in enumerate(part):
            ids[row, : len(all_ids[i])] = all_ids[i]
        yield part, ids, np.array([len(all_ids[i]) for i in part])
        at = stop


def viterbi(model: ShapeField, all_ids: list[np.ndarray]) -> list[np.ndarray]:
    """Best state sequences, many chains at a time."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(all_ids)
    for part, ids, lengths in _batches(all_ids):
        emit = model.weights[ids].sum(2)
        n, longest, k = emit.shape
        best = model.begin + emit[:, 0]
        back = np.zeros((n, longest, k), dtype=np.int8)
        for t in range(1, longest):
            total = best[:, :, None] + model.moves[None]
            back[:, t] = total.argmax(1)
            step = total.max(1) + emit[:, t]
            on = (t < lengths)[:, None]
            best = np.where(on, step, best)
            back[:, t] = np.where(on, back[:, t], np.arange(k))
        path = np.zeros((n, longest), dtype=np.int64)
        path[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(longest - 1, 0, -1):
            path[:, t - 1] = back[rows, t, path[:, t]]
        for row, i in enumerate(part):
            out[i] = path[row, : lengths[row]]
    return out


def _expect(model: ShapeField, ids: np.ndarray, lengths: np.ndarray):
    """Expected states and state changes by the forward-backward recursions, in logs."""
    emit = model.weights[ids].sum(2)
    n, longest, k = emit.shape
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    fwd[:, 0] = model.begin + emit[:, 0]
    for t in range(1, longest):
        s = fwd[:, t - 1, :, None] + model.moves[None]
        top = s.max(1, keepdims=True)
        fwd[:, t] = (top + np.log(np.exp(s - top).sum(1, keepdims=True)))[:, 0] + emit[:, t]
    for t in range(longest - 2, -1, -1):
        s = model.moves[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :]
        top = s.max(2, keepdims=True)
        new = (top + np.log(np.exp(s - top).sum(2, keepdims=True)))[:, :, 0]
        bwd[:, t] = np.where((t + 1 < lengths)[:, None], new, 0.0)
    last = fwd[np.arange(n), lengths - 1]
    top = last.max(1, keepdims=True)
    norm = (top + np.log(np.exp(last - top).sum(1, keepdims=True)))[:, :, None]
    states = np.exp(fwd + bwd - norm)
    inside = (np.arange(longest)[None] < lengths[:, None])[:, :, None]
    states *= inside
    pair = fwd[:, :-1, :, None] + model.moves[None, None] + (emit + bwd)[:, 1:, None, :]
    moves = (np.exp(np.minimum(pair - norm[..., None], 0)) * inside[:, 1:, :, None]).sum((0, 1))
    return states, moves


def fit(rows: list[tuple[list, list[int]]], steps: int = 60, ridge: float = 0.5, rate: float = 0.3) -> ShapeField:
    """Maximum likelihood with a ridge, by Adam, on labelled chains [(chain, states)]."""
    names: dict[str, int] = {}
    for chain, _ in rows:
        shapes = ["^", *(s for *_, s in chain), "$"]
        for i in range(1, len(shapes) - 1):
            for f in ("=" + shapes[i], "<" + shapes[i - 1], ">" + shapes[i + 1]):
                names.setdefault(f, len(names) + 1)
    k = len(STATES)
    model = ShapeField(names, np.zeros((len(names) + 1, k)), np.zeros((k, k)), np.zeros(k))
    all_ids = [model.ids(c) for c, _ in rows]
    groups = [(ids, n, [rows[i][1] for i in part]) for part, ids, n in _batches(all_ids, 1 << 16)]
    params = [model.weights, model.moves, model.begin]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        grads = [ridge * p for p in params]
        for ids, lengths, gold in groups:
            states, moves = _expect(model, ids, lengths)
            for row, states_of in enumerate(gold):
                states[row, np.arange(len(states_of)), states_of] -= 1.0
                for a, b in zip(states_of, states_of[1:]):
                    moves[a, b] -= 1.0
            flat = states.reshape(-1, k)
            for f in range(3):
                np.add.at(grads[0], ids[:, :, f].reshape(-1), flat)
            grads[1] += moves
            grads[2] += states[:, 0].sum(0)
        grads[0][0] = 0.0
        for i, (p, g) in enumerate(zip(params, grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    # A shape that no labelled row has leans to 'other' unless its neighbours say more.
    model.weights[0, 0] = 1.0
    return model


def labelled_chains(text: str, longest: int = 64):
    spans = base_spans(text)
    for chain in chains(text):
        for at in range(0, len(chain), longest):
            part = chain[at : at + longest]
            yield part, tags(part, spans)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ShapeField | None:
    """Fit on the bounded labelled table in one task: the table's states are the kinds of the base
    spans that a word overlaps.  None if no text has a word with a digit, @ or +."""
    # The sample is chosen by narrow rows; texts are read for the chosen ones alone.
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text"
    ).filter(F.col("text").rlike("[0-9@]"))
    first = rows.select(
        F.coalesce("doc_id", F.lit(0)).alias("at"), F.col("body").alias("at_body")
    ).orderBy(F.xxhash64("at"), "at", "at_body").limit(sample_rows).distinct()
    same = (F.coalesce(F.col("doc_id"), F.lit(0)) == F.col("at")) & (F.col("body") == F.col("at_body"))
    table = rows.join(F.broadcast(first), same).dropDuplicates(["at", "at_body"])

    def run(part: pa.Table) -> pa.Table:
        rows = [r for t in part.column("text").to_pylist() for r in labelled_chains(t)]
        model = fit(rows) if rows else None
        out = {"kind": [], "name": [], "value": []}
        if model:
            by_id = [None, *model.names]
            for kind, names, values in (
                ("w", by_id, model.weights), ("m", STATES, model.moves), ("b", ["begin"], model.begin[None]),
            ):
                out["kind"] += [kind] * len(values)
                out["name"] += list(names)
                out["value"] += values.tolist()
        return pa.table({
            "kind": pa.array(out["kind"], pa.string()), "name": pa.array(out["name"], pa.string()),
            "value": pa.array(out["value"], pa.list_(pa.float64())),
        })

    got = table.groupBy(F.lit(1).alias("one")).applyInArrow(
        run, "kind string, name string, value array<double>"
    ).collect()
    if not got:
        return None
    words = [r for r in got if r.kind == "w"]
    names = {r.name: i for i, r in enumerate(words) if r.name is not None}
    moves = {r.name: r.value for r in got if r.kind == "m"}
    return ShapeField(
        names, np.array([r.value for r in words]), np.array([moves[s] for s in STATES]),
        np.array(next(r.value for r in got if r.kind == "b")),
    )


def find_all(texts: list[str], model: ShapeField | None):
    """For each text its base spans and all spans: base and, where it overlaps none of them, the
    field's, one for each run of words of the same kind, without outer punctuation."""
    bases = [base_spans(t) for t in texts]
    extra: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model:
        owner, held, ids = [], [], []
        for i, text in enumerate(texts):
            for chain in chains(text):
                owner.append(i)
                held.append(chain)
                ids.append(model.ids(chain))
        for i, chain, states in zip(owner, held, viterbi(model, ids)):
            at = 0
            while at < len(chain):
                state = int(states[at])
                stop = at + 1
                while stop < len(chain) and states[stop] == state:
                    stop += 1
                words = [w for w in chain[at:stop] if w[1] > w[0]] if state else []
                at = stop
                if not words:
                    continue
                a, b = words[0][0], words[-1][1]
                while a < b and texts[i][a] in ".,;:!?()[]\"'":
                    a += 1
                while b > a and texts[i][b - 1] in ".,;:!?()[]\"'":
                    b -= 1
                if a < b and not any(x < b and a < y for x, _, y in bases[i]):
                    extra[i].append((a, state - 1, b))
    return bases, [sorted(x + y) if y else x for x, y in zip(bases, extra)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _pieces(texts: list[str], limit: int = 4_000_000):
    """Runs of texts of about ``limit`` characters, so that a batch's chains stay small."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def find_pii(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all of them)
    and n_added of every row.

    Null texts count as empty: no spans, the digest of the empty string.  Repeated rows stay repeated.
    """
    sent = df.sparkSession.sparkContext.broadcast(train(df))  # bounded by the labelled table

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bases, spans = [], []
            for piece in _pieces(texts):
                b, s = find_all(piece, sent.value)
                bases += b
                spans += s
            counts = [pa.array([sum(s[1] == k for s in b) for b in bases], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *counts, pa.array(digests, pa.string()),
                    pa.array(map(joined, spans), pa.string()),
                    pa.array([len(s) - len(b) for s, b in zip(spans, bases)], pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the union goes."""
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(df: DataFrame) -> DataFrame:
    """df with the found spans of ``text`` masked; null texts stay null, all rows and columns stay."""
    sent = df.sparkSession.sparkContext.broadcast(train(df))
    at = df.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new: list[str | None] = []
            for piece in _pieces([t or "" for t in texts]):
                new += [masked(t, s) for t, s in zip(piece, find_all(piece, sent.value)[1])]
            clean = pa.array([None if t is None else n for t, n in zip(texts, new)], pa.string())
            columns = list(batch.columns)
            columns[at] = clean
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)


def masked_documents(df: DataFrame) -> DataFrame:
    """``redact`` for a table of documents: a column n_chars follows the new text, 0 for null."""
    clean = redact(df)
    if "n_chars" not in df.columns:
        return clean
    length = F.coalesce(F.length("text"), F.lit(0)).cast(clean.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", length).select(*df.columns)
