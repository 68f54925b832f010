"""Personal data in texts: fixed patterns, and a skip-chain random field beyond them.

Patterns find e-mail addresses, IP addresses, payment cards and telephone
numbers.  The random field has a node for each token that may be personal data
(pattern matches, and tokens with a digit or an @).  Its potentials come from a
token's shape and neighbours, from the labels of consecutive nodes, and from
skip links between distant nodes that have the same content in any writing
(letters and digits only; the local part of an address; a number's last digits).
Loopy belief propagation then settles the labels of a document together, so a
token that is seen once in a clear context is found everywhere in the document.

Weights are trained piecewise on a bounded sample: the node part by gradient
descent on pattern matches and assigned secrets as labels, the two link parts
from how often linked nodes agree.  Pattern matches always stay.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import slices, text_bytes

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS, "secret"]
_RANK = {k: i for i, k in enumerate(LABELS[1:])}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs of digits are only looked at from their start and are never given back, which changes no match but keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASSIGNED = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*["']?([A-Za-z0-9_+/=-]{16,})""")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = "\"'`.,;:!?()[]{}<>|="


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    """Whether a run of digits is at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind.

    Each kind takes leftmost matches that do not overlap; matches that fail
    their check are dropped and not tried again in another way.
    """
    found: list[tuple[int, int, str]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        # an address starts where the run of local characters before its @ does
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            found.append((m.start(), m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], _RANK[s[2]]))


@dataclass
class Node:
    start: int
    end: int
    text: str
    before: str
    after: str
    fixed: int  # label of a pattern match, or 0


def nodes_of(text: str, base: list[tuple[int, int, str]]) -> list[Node]:
    """Pattern matches, and other tokens with a digit or an @, in order."""
    taken, end = [], -1
    for s, e, k in base:  # of matches that overlap, the first stands for all
        if s >= end:
            taken.append((s, e, LABELS.index(k)))
            end = e
    out: list[Node] = []
    words: list[tuple[int, int, int]] = []
    k = 0
    at = 0
    for s, e, label in [*taken, (len(text), len(text), -1)]:
        words += [(m.start(), m.end(), 0) for m in _TOKEN.finditer(text, at, s)]
        if label > 0:
            words.append((s, e, label))
        at = e
    for k, (s, e, label) in enumerate(words):
        token = text[s:e]
        if not label:
            left = len(token) - len(token.lstrip(_TRIM))
            token = token.strip(_TRIM)
            s, e = s + left, s + left + len(token)
            if not token or not ("@" in token or any("0" <= c <= "9" for c in token)):
                continue
        before = " ".join(text[a:b] for a, b, _ in words[max(0, k - 2) : k])[-40:]
        after = text[words[k + 1][0] : words[k + 1][1]][:20] if k + 1 < len(words) else ""
        out.append(Node(s, e, token, before, after, label))
    return out


def features(node: Node) -> list[str]:
    """Names of a node's features."""
    t = node.text
    d = _digits(t)
    letters = sum(c.isalpha() for c in t)
    parts = t.split(".")
    out = [
        "bias",
        f"digits={min(len(d), 20)}",
        f"letters={min(letters, 8)}",
        f"length={min(len(t) // 4, 12)}",
        f"at={'@' in t}",
        f"dots={min(t.count('.'), 4)}",
        f"plus={t[:1] == '+'}",
        f"marks={''.join(sorted({c for c in t if not c.isalnum()}))[:6]}",
    ]
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(f"quad={all(map(_octet, parts))}")
    if "@" in t:
        out.append(f"address={bool(_EMAIL.fullmatch(t))}")
    if 14 <= len(d) <= 19 and not letters:
        out.append(f"luhn={luhn(d)}")
    if len(t) >= 16 and letters and d and t.isalnum():
        out.append(f"hex={all(c in '0123456789abcdefABCDEF' for c in t)}")
    words = re.findall(r"[A-Za-z]+", node.before.lower())
    out += [f"word={w}" for w in words[-2:]]
    out.append(f"assigned={node.before.rstrip(chr(34) + chr(39))[-1:] in ('=', ':')}")
    return out


def keys(node: Node) -> list[str]:
    """What links a node to others with the same content, however written."""
    t = node.text.lower()
    plain = "".join(c for c in t if c.isalnum())
    out = [plain] if len(plain) >= 5 else []
    if "@" in t:
        local = "".join(c for c in t.split("@")[0] if c.isalnum())
        if len(local) >= 5:
            out.append(local)
    d = _digits(t)
    if len(d) >= 10 and len(d) >= len(plain) - 1:
        out.append(d[-10:])
    return list(dict.fromkeys(out))


def links(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links of near neighbours, and skip links from each node to the next one with a key in common."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= 60]
    last: dict[str, int] = {}
    skip = []
    for i, n in enumerate(nodes):
        seen = set()
        for k in keys(n):
            j = last.get(k)
            if j is not None and j not in seen:
                skip.append((j, i))
                seen.add(j)
            last[k] = i
    return chain, skip


@dataclass
class Field:
    """Weights: features x labels, and log potentials of chain and skip links."""

    index: dict[str, int]
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, nodes: list[Node]) -> np.ndarray:
        out = np.zeros((len(nodes), len(LABELS)))
        for i, n in enumerate(nodes):
            known = [self.index[f] for f in features(n) if f in self.index]
            out[i] = self.weights[known].sum(axis=0)
            if n.fixed:
                out[i] = -30.0
                out[i, n.fixed] = 0.0
        return out


def weak_labels(text: str, nodes: list[Node]) -> np.ndarray:
    """Labels to train on: pattern matches, and values assigned to secrets."""
    secret = [m.span(1) for m in _ASSIGNED.finditer(text)]
    return np.array([n.fixed or (5 if any(s <= n.start < e for s, e in secret) else 0) for n in nodes], int)


#: Features seen on fewer nodes than this are not used.
LEAST_SEEN = 3
#: Skip links of each label with itself that count as seen before training.
SAME = 5.0


def fit(texts: list[str], steps: int = 300, rate: float = 2.0, decay: float = 1e-3) -> Field:
    """Train on the texts given, in their order; no texts give a field that adds nothing."""
    m = len(LABELS)
    # before any link is seen: neighbours say nothing, and nodes of the same content have the same label more often than not
    rows, labels, pairs = [], [], {"chain": np.ones((m, m)), "skip": 0.1 + SAME * np.eye(m)}
    for text in texts:
        nodes = nodes_of(text, base_spans(text))
        y = weak_labels(text, nodes)
        rows += [features(n) for n in nodes]
        labels += y.tolist()
        for kind, edges in zip(("chain", "skip"), links(nodes), strict=True):
            for i, j in edges:
                pairs[kind][y[i], y[j]] += 1
    seen: dict[str, int] = {}
    for r in rows:
        for f in r:
            seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN))}
    weights = np.zeros((len(index), m))
    y = np.array(labels, int)
    if index:
        idx = [np.array([index[f] for f in r if f in index], int) for r in rows]
        flat, bounds = np.concatenate(idx), np.concatenate([[0], np.cumsum([len(x) for x in idx])])
        row = np.repeat(np.arange(len(idx)), np.diff(bounds))
        for k in range(steps):
            z = np.zeros((len(idx), m))
            for c in range(m):
                z[:, c] = np.bincount(row, weights[flat, c], len(idx))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            step = rate / (1 + k / 100)
            for c in range(m):
                weights[:, c] -= step * (np.bincount(flat, p[row, c], len(index)) / len(idx) * 4 + decay * weights[:, c])
    else:
        weights = np.zeros((0, m))
    tables = []
    for kind in ("chain", "skip"):
        joint = pairs[kind] / pairs[kind].sum()
        tables.append(np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True))).clip(-3, 3))
    chain, skip = tables
    return Field(index, weights, chain * 0.5, (skip + skip.T) / 2)


#: Edges along which messages are sent at a time.
EDGES = 1 << 14


def _send(said: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Messages (edges x labels) from what the senders believe, over edges that have one table; their largest is 0."""
    out = np.empty_like(said)
    for at in range(0, len(said), EDGES):
        x = said[at : at + EDGES, :, None] + table
        top = x.max(axis=1)
        msg = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        out[at : at + EDGES] = msg - msg.max(axis=1, keepdims=True)
    return out


def marginals(field: Field, nodes: list[Node], rounds: int = 12, damping: float = 0.3, skips: bool = True) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product; without ``skips`` on the chain alone."""
    unary = field.unary(nodes)
    chain, skip = links(nodes)
    edges = chain + (skip if skips else [])
    if edges:
        a, b = (np.array(x) for x in zip(*edges, strict=True))
        n = len(chain)
        ab, ba = np.zeros((len(edges), len(LABELS))), np.zeros((len(edges), len(LABELS)))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, b, ab)
            np.add.at(belief, a, ba)
            forth, back = belief[a] - ba, belief[b] - ab
            ab = damping * ab + (1 - damping) * np.concatenate([_send(forth[:n], field.chain), _send(forth[n:], field.skip)])
            ba = damping * ba + (1 - damping) * np.concatenate([_send(back[:n], field.chain.T), _send(back[n:], field.skip.T)])
        np.add.at(unary, b, ab)
        np.add.at(unary, a, ba)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


#: A node is added only if the field is this sure of its label.
SURE = 0.8


def spans(text: str, field: Field, skips: bool = True) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Pattern spans, and all spans with those that the field adds (without ``skips``, the field's chain); both in order."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    if not nodes:
        return base, base
    p = marginals(field, nodes, skips=skips)
    best = p.argmax(axis=1)
    more = [(n.start, n.end, LABELS[k]) for n, k, row in zip(nodes, best, p, strict=True) if k and not n.fixed and row[k] >= SURE]
    return base, sorted(base + more, key=lambda s: (s[0], _RANK[s[2]]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


#: Documents to train on at most, how many rows are looked through for them, and the characters of one at most.
SAMPLE, LOOKED, CHARACTERS = 1500, 30_000, 60_000


def training_texts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> list[str]:
    """At most SAMPLE texts with a digit or an @, of at most CHARACTERS characters, drawn by a hash of the id."""
    total = docs.count()
    if not total:
        return []
    u = F.pmod(F.xxhash64(F.col(id_column), F.lit(11)), F.lit(1 << 40))
    rows = docs.select(u.alias("_u"), F.col(text_column).alias("_text")).where(F.col("_u") < int(min(1.0, LOOKED / total) * (1 << 40)))
    rows = rows.where(F.col("_text").rlike("[0-9@]") & (F.length("_text") <= CHARACTERS))
    return rows.orderBy("_u", "_text").limit(SAMPLE).select("_text").toArrow().column(0).to_pylist()


def _candidates(column: pa.Array) -> np.ndarray:
    """Whether each text has a digit or an @; no other can hold a span."""
    raw, offsets = text_bytes(column)
    seen = np.concatenate([[0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))])
    return seen[offsets[1:]] > seen[offsets[:-1]]


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_spans(docs: DataFrame, field: Field, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and spans of each document, in code points.

    Null and empty texts have none; ids may be null or repeat, each row gives
    one row; other columns are ignored; an empty table gives no rows.
    Overlapping pattern matches of different kinds all stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = [x.split()[0] for x in DIGEST.split(", ")]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        f = sent.value
        for batch in slices(batches, "text"):
            n = batch.num_rows
            counts = np.zeros((len(KINDS), n), np.int64)
            digest, found, added = [nothing] * n, [""] * n, [0] * n
            for i in np.flatnonzero(_candidates(batch.column(1))).tolist():
                base, full = spans(batch.column(1)[i].as_py(), f)
                for s in base:
                    counts[_RANK[s[2]], i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                found[i], added[i] = joined(full), len(full) - len(base)
            columns = [batch.column(0), *[pa.array(c) for c in counts], pa.array(digest), pa.array(found), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, DIGEST)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s, e, k in found:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, field: Field, *, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """Replace spans in the texts, keeping all columns, whatever their names; the length column follows the text."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_column)
    rows = docs.toDF(*names)

    def run(batches):
        f = sent.value
        for batch in slices(batches, names[place]):
            hits = np.flatnonzero(_candidates(batch.column(place)))
            if len(hits):
                texts = batch.column(place).to_pylist()
                for i in hits.tolist():
                    texts[i] = masked(texts[i], spans(texts[i], f)[1])
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield batch

    out = rows.mapInArrow(run, rows.schema)
    if length_column in docs.columns:
        length = names[docs.columns.index(length_column)]
        out = out.withColumn(length, F.length(names[place]).cast(docs.schema[length_column].dataType))
    return out.toDF(*docs.columns)
