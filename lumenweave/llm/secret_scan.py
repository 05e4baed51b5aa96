"""Operator 10: secret scans by one combined deterministic automaton.

All rules' patterns are compiled to one NFA, determinised by subset construction over byte classes and
minimised. The scan is a single pass over the bytes of a batch of texts: these are cut at every byte that leads
to the start from everywhere, and long pieces into blocks, whose entries are put right afterwards; all
pieces step together through the transition array, which gives the rules that match in each. In the pieces
where some do, a second automaton of all rules, anchored, reads the exact spans: leftmost, longest and
non-overlapping for each rule, all rules in one walk.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, read_table

# --- patterns: a small regular-expression language -> NFA -----------------------------------------


def _parse(pattern: str, fold: bool):
    """A syntax tree of: literals, escapes, [classes], groups, |, ?, *, +, {m}, {m,}, {m,n}."""
    pos = 0

    def peek():
        return pattern[pos] if pos < len(pattern) else ""

    def take():
        nonlocal pos
        pos += 1
        return pattern[pos - 1]

    def byte():
        c = take()
        if c != "\\":
            return ord(c)
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def both(values):
        if not fold:
            return frozenset(values)
        return frozenset(x for v in values for x in ({v, v ^ 32} if 65 <= v & ~32 <= 90 else {v}))

    def atom():
        if peek() == "(":
            take()
            inner = either()
            if take() != ")":
                raise ValueError(f"unclosed group in {pattern!r}")
            return inner
        if peek() == "[":
            take()
            negated = peek() == "^" and bool(take())
            values: set[int] = set()
            while peek() != "]":
                a = byte()
                if peek() == "-" and pattern[pos + 1 : pos + 2] != "]":
                    take()
                    values.update(range(a, byte() + 1))
                else:
                    values.add(a)
            take()
            return ("set", frozenset(range(256)) - both(values) if negated else both(values))
        return ("set", both({byte()}))

    def repeated():
        node = atom()
        while peek() in ("?", "*", "+", "{") and peek():
            op = take()
            if op == "{":
                body = ""
                while peek() != "}":
                    body += take()
                take()
                low, _, high = body.partition(",")
                m, n = int(low), (None if body.endswith(",") else int(high or low))
            else:
                m, n = {"?": (0, 1), "*": (0, None), "+": (1, None)}[op]
            node = ("rep", node, m, n)
        return node

    def sequence():
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("seq", parts)

    def either():
        options = [sequence()]
        while peek() == "|":
            take()
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    tree = either()
    if pos != len(pattern):
        raise ValueError(f"can't read {pattern!r} at {pos}")
    return tree


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.move: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append([])
        return len(self.eps) - 1

    def build(self, node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.move[start].append((node[1], end))
            return end
        if kind == "seq":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for option in node[1]:
                first = self.state()
                self.eps[start].append(first)
                self.eps[self.build(option, first)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop = self.state()
            self.eps[start].append(loop)
            self.eps[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.eps[start].append(end)
        for _ in range(high - low):
            start = self.build(inner, start)
            self.eps[start].append(end)
        return end


class Dfa:
    """A minimal automaton: ``table[state * 256 + byte]``, ``accepts[state]`` a bit mask of rules; state 0 starts.

    ``search`` keeps the start alive at every byte (for the flagging pass); otherwise the last state is dead.
    """

    def __init__(self, patterns: list[tuple[str, bool]], search: bool):
        nfa = _Nfa()
        start = nfa.state()
        final: dict[int, int] = {}
        for k, (pattern, fold) in enumerate(patterns):
            first = nfa.state()
            nfa.eps[start].append(first)
            end = nfa.build(_parse(pattern, fold), first)
            final[end] = final.get(end, 0) | 1 << k

        signature = {}
        sets = sorted({s for moves in nfa.move for s, _ in moves}, key=sorted)
        classes = np.zeros(256, dtype=np.int64)
        for b in range(256):
            key = tuple(b in s for s in sets)
            classes[b] = signature.setdefault(key, len(signature))
        example = [int(np.argmax(classes == c)) for c in range(len(signature))]

        def closure(states):
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        begin = closure({start})
        number, rows, todo = {begin: 0}, [], [begin]
        while todo:  # subset construction
            following = []
            for subset in todo:
                row = []
                for b in example:
                    to = {t for s in subset for values, t in nfa.move[s] if b in values}
                    nxt = closure(to) | (begin if search else frozenset())
                    if nxt not in number:
                        number[nxt] = len(number)
                        following.append(nxt)
                    row.append(number[nxt])
                rows.append(row)
            todo = following
        # numbering is by discovery, and rows are appended in the same order
        trans = np.array(rows, dtype=np.int64)
        accepts = np.array([sum({final[s] for s in subset if s in final}) for subset in number], dtype=np.int64)

        block = np.unique(accepts, return_inverse=True)[1]
        while True:  # refine until no block splits
            finer = np.unique(np.column_stack([block, block[trans]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        order = np.full(block.max() + 1, -1)
        order[block[0]] = 0
        order[order < 0] = np.arange(1, len(order))
        block = order[block]
        first = np.unique(block, return_index=True)[1]
        small = block[trans[first]]
        self.n = len(first)
        self.table = small[:, classes].astype(np.int32).ravel()
        self.accepts = accepts[first]
        # bytes that lead to the start from everywhere: text may be cut behind them
        self.resets = [b for b in range(256) if search and (self.table[b::256] == 0).all()]

    def ends(self, data: bytes, at: int, wanted: int) -> dict[int, int]:
        """Rule -> end of its longest match that begins at ``at``, of the rules in the mask (for an automaton without ``search``)."""
        rows, accepts, state, found = self.rows(), self.accepting(), 0, {}
        for i in range(at, len(data)):
            state = rows[state][data[i]]
            if state < 0:
                break
            mask = accepts[state] & wanted
            while mask:
                low = mask & -mask
                found[low.bit_length() - 1] = i + 1
                mask ^= low
        return found

    def rows(self):
        if not hasattr(self, "_rows"):
            t = self.table.reshape(-1, 256)
            alive = self.accepts > 0
            for _ in range(self.n):
                grown = alive | alive[t].any(axis=1)
                if (grown == alive).all():
                    break
                alive = grown
            self._rows = np.where(alive[t], t, -1).tolist()
        return self._rows

    def accepting(self):
        if not hasattr(self, "_acc"):
            self._acc = self.accepts.tolist()
        return self._acc


# --- rules ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, longest, without overlap; then ``keep(match bytes)`` filters."""

    kind: str
    pattern: str
    fold: bool = False
    min_length: int = 0
    value_min: int = 0  # of what follows the separator, for assignments

    def keep(self, found: bytes) -> bool:
        if len(found) < self.min_length:
            return False
        return not self.value_min or len(_value(found)) >= self.value_min


_VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def _value(found: bytes) -> bytes:
    """What follows the first separator of an assignment, and its quote."""
    at = next(i for i, b in enumerate(found) if b in b":=") + 1
    while found[at] == 32:
        at += 1
    return found[at + (found[at] in b"\"'") :]


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, value_min=6),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: The method's own additions; their spans come beside the base ones and never replace them.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
    Rule("hosted", r"(ghp_|gho_|ghs_|xox[abp]-|sk_live_)[A-Za-z0-9\-]+", min_length=20),
)


BLOCK = 256  # bytes that one step sequence takes at most
WINDOW = 1 << 20  # bytes of texts that are scanned together


class Scanner:
    """All rules in one automaton; spans of a text as (start, end, rule number) in code points."""

    def __init__(self, rules=BASE_RULES + MORE_RULES):
        self.rules = tuple(rules)
        self.all = Dfa([(r.pattern, r.fold) for r in self.rules], True)
        self.anchored = Dfa([(r.pattern, r.fold) for r in self.rules], False)
        row = self.anchored.rows()[0]
        self.begins = [row[b] >= 0 for b in range(256)]
        self.is_reset = np.zeros(256, dtype=bool)
        self.is_reset[self.all.resets] = True
        self.accepting = self.all.accepts > 0
        if not self.all.resets:
            raise ValueError("the rules leave no byte at which texts may be cut")

    def _pieces(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the stretches between reset bytes."""
        edge = np.diff(np.concatenate([[0], (~self.is_reset[buf]).view(np.int8), [0]]))
        starts = np.flatnonzero(edge == 1)
        return starts, np.flatnonzero(edge == -1) - starts

    def flags(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per piece the mask of rules that match in it: one pass over the bytes, all blocks of all pieces in step.

        Every block is entered as if at the start. Where the block before it ends in another state, the block is
        walked again from that state until both walks are in one state, behind which nothing differs.
        """
        if not len(starts):
            return np.empty(0, dtype=np.int64)
        n_blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(starts)), n_blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        at = starts[owner] + number * BLOCK
        size = np.minimum(lengths[owner] - number * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        place = at[order]
        active = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), side="right")
        table, accepts = self.all.table, self.all.accepts
        state, mask = np.zeros(len(owner), dtype=np.int32), np.zeros(len(owner), dtype=np.int64)
        for i, n in enumerate(active.tolist()):
            s = table[(state[:n] << 8) + buf[place[:n] + i]]
            state[:n] = s
            hit = self.accepting[s]
            if hit.any():
                mask[:n] |= accepts[s]
        last, found = np.empty_like(state), np.empty_like(mask)
        last[order], found[order] = state, mask
        for k in np.flatnonzero((number[1:] > 0) & (last[:-1] != 0)).tolist() if len(owner) > 1 else ():
            # in ascending order, so that the state a block is entered in is already right
            self._again(buf, k + 1, int(last[k]), int(at[k + 1]), int(size[k + 1]), last, found)
            # a block that now ends elsewhere reaches into the next one, which the list may not hold
            j = k + 1
            while j + 1 < len(owner) and number[j + 1] > 0 and last[j] != 0 and self._moved:
                self._again(buf, j + 1, int(last[j]), int(at[j + 1]), int(size[j + 1]), last, found)
                j += 1
        out = np.zeros(len(starts), dtype=np.int64)
        np.bitwise_or.at(out, owner, found)
        return out

    def _again(self, buf, k: int, state: int, at: int, size: int, last: np.ndarray, found: np.ndarray) -> None:
        table, accepts, other = self.all.table, self.all.accepts, 0
        mask = 0
        for b in buf[at : at + size].tolist():
            state, other = int(table[(state << 8) + b]), int(table[(other << 8) + b])
            mask |= int(accepts[state])
            if state == other:
                self._moved = False
                break
        else:
            self._moved = int(last[k]) != state
            last[k] = state
        found[k] |= mask

    def resolve(self, data: bytes, wanted: int) -> list[tuple[int, int, int]]:
        """The spans of the rules in the mask, in bytes."""
        out, free, begins = [], [0] * len(self.rules), self.begins
        for at, b in enumerate(data):
            if not begins[b]:
                continue
            mask = sum(1 << r for r in range(len(free)) if wanted >> r & 1 and free[r] <= at)
            for r, end in self.anchored.ends(data, at, mask).items() if mask else ():
                if self.rules[r].keep(data[at:end]):
                    out.append((at, end, r))
                free[r] = end
        return out

    def _parts(self, texts: list[bytes | None]):
        """Groups of (text number, place, bytes) of WINDOW bytes together or less, texts cut behind reset bytes: no match reaches over one. Bytes without any stay together."""
        group, size = [], 0
        for k, t in enumerate(texts):
            t, at = t or b"", 0
            while at < len(t):
                end = min(at + WINDOW, len(t))
                if end < len(t):
                    hit = np.flatnonzero(self.is_reset[np.frombuffer(t, dtype=np.uint8, count=end - at, offset=at)])
                    while not len(hit) and end < len(t):
                        more = min(WINDOW, len(t) - end)
                        hit = np.flatnonzero(self.is_reset[np.frombuffer(t, dtype=np.uint8, count=more, offset=end)])[:1] + (end - at)
                        end += more
                    end = at + int(hit[-1]) + 1 if len(hit) else len(t)
                if group and size + end - at > WINDOW:
                    yield group
                    group, size = [], 0
                group.append((k, at, t[at:end]))
                size += end - at
                at = end
        if group:
            yield group

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int]]]:
        """Spans of each text, by start and then rule; offsets in code points, end exclusive."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        cut = bytes([self.all.resets[0]])
        before = [0] * len(texts)  # code points of each text's parts so far
        for group in self._parts(texts):
            buf = np.frombuffer(cut.join(p for _, _, p in group), dtype=np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(p) + 1 for _, _, p in group])])[:-1]
            starts, lengths = self._pieces(buf)
            masks = self.flags(buf, starts, lengths)
            hit = np.flatnonzero(masks)
            of = np.searchsorted(begin, starts[hit], side="right") - 1
            at, points = -1, None
            for i, g in zip(hit.tolist(), of.tolist()):
                k, _, part = group[g]
                a = int(starts[i] - begin[g])
                spans = self.resolve(part[a : a + int(lengths[i])], int(masks[i]))
                if spans and at != g:  # code points before each byte of the part
                    own = np.frombuffer(part, dtype=np.uint8)
                    points, at = None if part.isascii() else np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)]), g
                    base = before[k] + sum(_points(p) for j, _, p in group[:g] if j == k)
                for x, y, r in spans:
                    x, y = (a + x, a + y) if points is None else (int(points[a + x]), int(points[a + y]))
                    found[k].append((base + x, base + y, r))
            for k, _, part in group:
                before[k] += _points(part)
        for spans in found:
            spans.sort(key=lambda s: (s[0], s[2]))
        return found


def _points(part: bytes) -> int:
    """Code points that begin in the bytes."""
    return len(part) if part.isascii() else int(np.count_nonzero((np.frombuffer(part, dtype=np.uint8) & 0xC0) != 0x80))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_made: dict = {}


def _scanner(rules):
    if rules not in _made:
        _made[rules] = Scanner(rules)
    return _made[rules]


def secret_spans(docs: DataFrame, text_col: str = "text", rules=BASE_RULES + MORE_RULES, out_col: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out_col``: an array of (kind, start, end) in code points, by start and then rule order.

    A null or empty text has an empty array. Spans of one rule never overlap; spans of different rules
    may, and of those with one start the rule named first comes first. Texts are scanned whole, however long. Repeated rows, null ids and all other columns pass
    through; a column named ``out_col`` is replaced. An empty table gives an empty result.
    """
    rules = tuple(rules)

    shared = docs.sparkSession.sparkContext.broadcast(_scanner(rules))  # arrays of about 4,000 states

    def make():
        scanner = shared.value

        def run(texts):
            return [[[{"kind": rules[r].kind, "start": a, "end": b} for a, b, r in spans] for spans in scanner.scan(texts)]]

        return run

    return annotate(docs, text_col, make, T.StructType([T.StructField(out_col, T.ArrayType(SPAN))]))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", length_col: str = "n_chars", rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``; overlapping spans become one. Null stays null, and so does an empty text.

    Texts are scanned whole, however long; repeated rows, null ids and other columns pass through, whatever their names;
    an empty table gives an empty result. Where there is a column ``length_col``, it gets the new length in characters of texts that changed.
    """
    rules, fields = tuple(rules), list(docs.columns)

    shared = docs.sparkSession.sparkContext.broadcast(_scanner(rules))  # arrays of about 4,000 states

    def make():
        scanner = shared.value

        def run(texts):
            out, changed = [], []
            for t, spans in zip(texts, scanner.scan(texts)):
                changed.append(bool(spans))
                if spans:
                    s, parts, at = t.decode("utf-8", "replace"), [], 0
                    merged: list[list[int]] = []
                    for a, b, _ in spans:
                        if merged and a < merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    for a, b in merged:
                        parts += [s[at:a], mark]
                        at = b
                    t = "".join([*parts, s[at:]]).encode()
                out.append(None if t is None else t.decode("utf-8", "replace"))
            return out, changed

        return run

    done = annotate(docs, text_col, make, T.StructType([T.StructField("__lw_text", T.StringType()), T.StructField("__lw_changed", T.BooleanType())]))
    new = {text_col: F.col("__lw_text")}
    if length_col in fields:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.when(F.col("__lw_changed"), F.length("__lw_text").cast(kind)).otherwise(F.col(length_col))
    return done.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in fields])


DIGEST = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in ("assign", "access", "hex")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of the base kinds, the digest of the base spans and all spans as text.

    A null or empty text has no spans (counts 0, the digest of an empty string). Spans with one start stand in the rules' order. Repeated rows and
    null ids come back as they are, very long texts are scanned whole, an empty table gives an empty result. Columns other than id and text are
    ignored, whatever their names.
    """
    rules = BASE_RULES + MORE_RULES
    n_base = len(BASE_RULES)

    shared = docs.sparkSession.sparkContext.broadcast(_scanner(rules))  # arrays of about 4,000 states

    def make():
        scanner = shared.value

        def run(texts):
            cols = [[] for _ in range(5)]
            for spans in scanner.scan(texts):
                base = [s for s in spans if s[2] < n_base]
                for k in range(3):
                    cols[k].append(sum(s[2] == k for s in base))
                say = lambda x: ",".join(f"{rules[r].kind}:{a}:{b}" for a, b, r in x)
                cols[3].append(hashlib.sha256(say(base).encode()).hexdigest())
                cols[4].append(say(spans))
            return cols

        return run

    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    return annotate(source, "__text", make, DIGEST).drop("__text").withColumnRenamed("__id", id_col)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))
