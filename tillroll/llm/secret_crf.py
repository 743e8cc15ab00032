"""Secret scans: three fixed patterns and a linear-chain conditional random field.

The patterns (``base_spans``) always report.  The field tags white-space tokens
as outside, begin or inside a secret from each token's shape, length, variety
of characters and key-like start, the shapes and known words next to it, and
two features of the whole text; what it tags apart from the patterns' spans is
added with kind ``crf``.

It is trained by maximum likelihood on windows of tokens around the patterns'
own matches, and around the most unusual other tokens, from at most
``SAMPLE_HITS`` documents with a match and ``SAMPLE_CLEAN`` without one (those
of smallest hash of id and text, equal ones once; at most ``WINDOWS_PER_DOC``
windows of each).  Every document is looked at for matches, so rare secrets are
learnt from however large the corpus is.  Decoding is Viterbi over whole texts:
making a token outside changes the transitions on its two sides and, where an
inside follows, turns that into a begin, with its emission and the transition
after it.  A token whose score outside leads by more than all of this is worth
is outside in every best path, so the path only has to be searched between such
tokens; that gives the same path.

Defined cases: null and empty texts have no spans; without any pattern match in
the corpus nothing is added; rows that repeat an id are scanned each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.arrow import pieces
from tillroll.llm.memo import Memo
from tillroll.llm.tables import written
from tillroll.llm.wordpiece_count import words

SAMPLE_HITS, SAMPLE_CLEAN = 4_000, 4_000
WINDOWS_PER_DOC = 8
REACH = 12  # tokens on either side of a training window's middle
ROUNDS = 150
OUT, BEGIN, IN = 0, 1, 2
NEVER = -1e9

# The patterns.
KINDS = ("assign", "access", "hex")
KEYS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(
    rf"({'|'.join(KEYS)})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_HINTS = ("passw", "secret", "token", "api")

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_KEY = re.compile(r"[\"']?([A-Za-z_]{2,20})[\"']?[:=]")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_BEYOND = re.compile(r"[^\x00-\x7f]+")
#: Words as running text has them: a capital at most, small letters, one mark.
_PLAIN = re.compile(r"([A-Z]?)((?:[a-z]|[^\x00-\x7f])*)([.,;!?]?)")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


# ------------------------------------------------------------------ features


def _shape_table() -> dict[int, str]:
    out = {}
    for c in range(128):
        x = chr(c)
        out[c] = "a" if x.islower() else "A" if x.isupper() else "0" if x.isdigit() else x
    return out


_SHAPES = _shape_table()


def shape(token: str) -> str:
    """Classes of characters with runs shortened; letters beyond ASCII count as
    small letters."""
    return _RUN.sub(r"\1", _BEYOND.sub("a", token[:200].translate(_SHAPES)))[:12]


def _bucket(n: int) -> int:
    return int(n).bit_length()


def own_features(token: str) -> list[str]:
    digits = sum(map(str.isdigit, token))
    out = [f"shape {shape(token)}", f"long {_bucket(len(token) // 4)}", f"digits {digits * 4 // len(token)}"]
    out.append(f"long {_bucket(len(token) // 4)} digits {digits * 4 // len(token)}")
    out.append(f"kinds {_bucket(len(set(token)))}")
    if len(token) >= 16:
        out.append(f"start {token[:4]}")
    if key := _KEY.match(token):
        out.append(f"key {key[1].lower()}")
    return out


def side_features(token: str, side: str) -> list[str]:
    """What a token says about the one after (``before``) or ahead (``after``)."""
    return [f"{side} {shape(token)}", f"{side} word {token.lower()[:20]}"]


def file_features(tokens: list[str], numbered: int) -> list[str]:
    return [f"file digits {_bucket(1000 * numbered // max(1, len(tokens)))}", f"file long {_bucket(len(tokens)) // 2}"]


# ------------------------------------------------------------------ training


def _tags(text: str, spans) -> tuple[list[str], list[int]]:
    """Tokens and the tags that the spans give them."""
    tokens, tags, at = [], [], 0
    edges = sorted((s, e) for s, _, e in spans)
    merged: list[list[int]] = []
    for s, e in edges:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    inside = -1
    for m in _TOKEN.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        hit = at < len(merged) and merged[at][0] < m.end()
        tags.append(OUT if not hit else IN if inside == at else BEGIN)
        inside = at if hit else -1
        tokens.append(m[0])
    return tokens, tags


def training_windows(text: str) -> list[tuple[list[str], list[int], int, int]]:
    """(tokens with one more on either side, tags, tokens of the text, tokens
    with digits) of a document's windows."""
    tokens, tags = _tags(text, base_spans(text))
    if not tokens:
        return []
    hits = [i for i, t in enumerate(tags) if t == BEGIN]
    odd = sorted((i for i, t in enumerate(tags) if t == OUT), key=lambda i: (-len(tokens[i]) - 20 * any(map(str.isdigit, tokens[i])), i))
    numbered = sum(any(map(str.isdigit, t)) for t in tokens)
    out = []
    for i in hits[:WINDOWS_PER_DOC] + odd[:2]:
        low, high = max(0, i - REACH), min(len(tokens), i + REACH)
        padded = [tokens[low - 1] if low else "", *tokens[low:high], tokens[high] if high < len(tokens) else ""]
        out.append((padded, tags[low:high], len(tokens), numbered))
    return out


class Field:
    """Weights by feature (one for each tag), transitions and first-tag scores."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray) -> None:
        self.weights = weights
        self.moves = moves

    def score(self, names: list[str]) -> np.ndarray:
        out = np.zeros(3)
        for n in names:
            w = self.weights.get(n)
            if w is not None:
                out += w
        return out


def fit(windows: list[tuple[list[str], list[int], int, int]]) -> Field | None:
    """Full-batch maximum likelihood (adaptive steps, L2 penalty), the
    forward-backward sums of all windows in step."""
    if not any(BEGIN in tags for _, tags, _, _ in windows):
        return None
    longest = max(len(tags) for _, tags, _, _ in windows)
    counts: Counter = Counter()
    listed = []
    for padded, tags, n, numbered in windows:
        whole = file_features([""] * n, numbered)
        rows = []
        for i in range(1, len(padded) - 1):
            names = own_features(padded[i]) + whole
            names += side_features(padded[i - 1], "before") if padded[i - 1] else ["before nothing"]
            names += side_features(padded[i + 1], "after") if padded[i + 1] else ["after nothing"]
            counts.update(names)
            rows.append(names)
        listed.append(rows)
    names = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 3))}
    cell, feature = [], []
    gold = np.full((len(windows), longest), -1)
    for w, rows in enumerate(listed):
        gold[w, : len(rows)] = windows[w][1]
        for i, found in enumerate(rows):
            known = [names[f] for f in found if f in names]
            cell += [w * longest + i] * len(known)
            feature += known
    cell, feature = np.array(cell), np.array(feature)
    there = gold >= 0
    weights, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    blocked = np.zeros((3, 3))
    blocked[OUT, IN] = NEVER
    first = np.array([0.0, 0.0, NEVER])
    gold_hot = np.zeros((*gold.shape, 3))
    for y in range(3):
        gold_hot[..., y] = gold == y
    gold_moves = np.einsum("wty,wtz->yz", gold_hot[:, :-1], gold_hot[:, 1:])
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    top = lambda x, axis: x.max(axis=axis, keepdims=True)

    def add(x: np.ndarray, axis: int) -> np.ndarray:
        m = top(x, axis)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(ROUNDS):
        emit = np.stack([np.bincount(cell, weights=weights[feature, y], minlength=gold.size) for y in range(3)], axis=1)
        emit = emit.reshape(*gold.shape, 3)
        move = moves + blocked
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + first
        for t in range(1, longest):
            ahead[:, t] = np.where(there[:, t, None], add(ahead[:, t - 1, :, None] + move, 1) + emit[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back[:, t] = np.where(there[:, t + 1, None], add(move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2), back[:, t + 1])
        total = add(ahead[:, -1], 1)
        tag = np.exp(np.minimum(ahead + back - total[:, None, None], 0)) * there[..., None]
        pair = ahead[:, :-1, :, None] + move + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * there[:, 1:, None, None]
        slope = (gold_hot - tag).reshape(-1, 3)
        by_weight = np.stack([np.bincount(feature, weights=slope[cell, y], minlength=len(names)) for y in range(3)], axis=1)
        by_weight -= 0.05 * weights
        by_move = gold_moves - pair.sum(axis=(0, 1)) - 0.05 * moves
        by_move[OUT, IN] = 0
        seen_w += by_weight**2
        seen_m += by_move**2
        weights += 0.3 * by_weight / np.sqrt(seen_w)
        moves += 0.3 * by_move / np.sqrt(seen_m)
    return Field({f: weights[i] for f, i in names.items() if np.abs(weights[i]).max() > 1e-3}, moves + blocked)


def _text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("said")


def trained(docs: DataFrame) -> Field | None:
    """The field fitted on the bounded sample."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key())

    def matches(batches):
        for batch in pieces(batches, 2):
            hit = pa.array([bool(base_spans(t or "")) for t in batch.column(2).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hit], ["doc_id", "said", "hit"])

    looked = docs.select("doc_id", "said", "text").mapInArrow(matches, "doc_id long, said binary, hit boolean")
    looked = written(looked.distinct(), "matches")

    def some(hit: bool, n: int) -> DataFrame:
        return looked.where(F.col("hit") == hit).orderBy(F.xxhash64("doc_id", "said"), "doc_id", "said").limit(n).select("doc_id", "said")

    chosen = some(True, SAMPLE_HITS).union(some(False, SAMPLE_CLEAN))

    def windows(batches):
        for batch in pieces(batches, 1):
            found = [(d, *w) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in training_windows(t or "")]
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64())
            names = ["doc_id", "tokens", "tags", "n", "numbered"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    sample = docs.join(F.broadcast(chosen), ["doc_id", "said"])  # at most SAMPLE_HITS + SAMPLE_CLEAN ids and texts
    sample = sample.dropDuplicates(["doc_id", "said"]).select("doc_id", "text")
    rows = sample.mapInArrow(windows, "doc_id long, tokens array<string>, tags array<long>, n long, numbered long")
    rows = rows.orderBy("doc_id", "tokens").toArrow().to_pylist()
    return fit([(r["tokens"], r["tags"], r["n"], r["numbered"]) for r in rows])


# ------------------------------------------------------------------ decoding


class _Scores(Memo):
    """token -> row of its scores: its own, to the token after, to the one before.
    Tokens whose features are the same share a row."""

    def __init__(self, field: Field) -> None:
        super().__init__(self.row)
        self.field = field
        self.rows = np.zeros((1 << 10, 3, 3), dtype=np.float32)
        self.by_key: dict[tuple, int] = {}
        self.words = {f.split(" word ", 1)[1] for f in field.weights if " word " in f}
        self.starts = {f.split(" ", 1)[1] for f in field.weights if f.startswith("start ")}

    def key(self, token: str) -> tuple:
        """All that the features of a token depend on."""
        low = token.lower()[:20]
        word = low if low in self.words else None
        start = token[:4] if len(token) >= 16 and token[:4] in self.starts else None
        size, kinds = _bucket(len(token) // 4), _bucket(len(set(token)))
        plain = _PLAIN.fullmatch(token)
        if plain:
            return (plain[1] != "", plain[2] != "", plain[3], size, kinds, start, word)
        digits = sum(map(str.isdigit, token)) * 4 // len(token)
        named = _KEY.match(token)
        return (shape(token), digits, size, kinds, start, word, named[1].lower() if named else None, None)

    def row(self, token: str) -> int:
        key = self.key(token)
        n = self.by_key.get(key)
        if n is None:
            n = self.by_key[key] = len(self.by_key)
            if n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n] = [
                self.field.score(own_features(token)),
                self.field.score(side_features(token, "before")),
                self.field.score(side_features(token, "after")),
            ]
        return n


def viterbi(emit: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    """Best tags; ``first`` and ``last`` score the ends' transitions."""
    score, links = emit[0] + first, []
    for e in emit[1:]:
        step = score[:, None] + moves
        links.append(step.argmax(axis=0))
        score = step.max(axis=0) + e
    tag = int((score + last).argmax())
    tags = [tag]
    for link in reversed(links):
        tag = int(link[tag])
        tags.append(tag)
    return tags[::-1]


class Tagger:
    def __init__(self, field: Field) -> None:
        self.field = field
        self.scores = _Scores(field)
        allowed = field.moves[field.moves > NEVER / 2]
        self.slack = 3 * float(allowed.max() - allowed.min()) + 1e-3
        self.edge = field.score(["before nothing"]), field.score(["after nothing"])
        self.start = np.array([0.0, 0.0, NEVER])

    def emissions(self, tokens: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.scores.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        rows = self.scores.rows[at]
        emit = rows[:, 0].astype(np.float64)
        emit[1:] += rows[:-1, 1]
        emit[:-1] += rows[1:, 2]
        emit[0] += self.edge[0]
        emit[-1] += self.edge[1]
        numbered = sum(1 for t in tokens if not t.isalpha() and any(map(str.isdigit, t)))
        return emit + self.field.score(file_features(tokens, numbered))

    def tags(self, tokens: list[str]) -> dict[int, int]:
        """The tags of the tokens that aren't outside."""
        emit = self.emissions(tokens)
        after = np.append(np.maximum(emit[1:, IN] - emit[1:, BEGIN], 0), 0)  # what the next token loses as a begin
        open_ = np.flatnonzero(emit[:, OUT] - emit[:, 1:].max(axis=1) <= self.slack + after)
        out: dict[int, int] = {}
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            low, high = int(run[0]), int(run[-1]) + 1
            first = self.field.moves[OUT] if low else self.start
            last = self.field.moves[:, OUT] if high < len(tokens) else np.zeros(3)
            for i, tag in enumerate(viterbi(emit[low:high], self.field.moves, first, last)):
                if tag != OUT:
                    out[low + i] = tag
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code-point spans of the tagged secrets."""
        tokens = words(text)
        if not tokens:
            return []
        tags = self.tags(tokens)
        if not tags:
            return []
        out: list[list[int]] = []
        for i, m in enumerate(_TOKEN.finditer(text)):
            if tags.get(i) == BEGIN:
                out.append([m.start(), m.end()])
            elif i in tags:
                out[-1][1] = m.end()
        return [(s, e) for s, e in out]


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, spans(array of kind, start, end)``."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs))

    def scan(batches):
        field = shared.value
        tagger = Tagger(field) if field else None
        for batch in pieces(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = tagger.spans(text) if tagger else []
                added = [(s, "crf", e) for s, e in more if not any(s < y and x < e for x, _, y in base)]
                order = {k: i for i, k in enumerate((*KINDS, "crf"))}
                spans = sorted(base + added, key=lambda x: (x[0], order[x[1]]))
                out.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the patterns' spans, and all spans as a string."""
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *map(number, KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
