"""SentencePiece encoding and decoding with sampled segmentations, without replacement.

The lattice of a text has a node after every character and an edge for every piece of the model that
spells out the characters between two nodes (byte pieces where no piece has the character). White
space only begins pieces, so the lattice is a chain of independent units (a word with the space
before it); the log-mass of every partial segmentation is exact, from forward sums in each unit.

``k`` segmentations are drawn by Gumbel top-k: the first is the argmax of Gumbel-perturbed
log-probabilities, an exact sample. The search then keeps a queue of disjoint subspaces, "as this
path up to unit j, different in unit j", each with its exact log-mass as the A* bound and the
perturbed maximum it holds, a Gumbel truncated at that of the subspace it was cut from. Taking the
best subspace, sampling its path and splitting what is left of it yields the next one, distinct from
all before. The best left after ``k`` is the threshold of the inclusion scores: with log-probability
p and threshold t, a segmentation's chance to be among the drawn is 1 - exp(-exp(p - t)); its
logarithm is returned, as whole texts have tiny probabilities.

Random numbers are a hash of (seed, row key, unit, sample, step), so a repeated task repeats its
result, however rows are grouped into batches.

Weights. A BPE model has merge ranks, not probabilities: a piece of rank r weighs 1 / (r + 1), to the
power ``theta``; a unigram model's own scores are taken as they are.

Defined cases: a null or empty text has one segmentation without pieces; a text with fewer than
``k`` segmentations gives them all, the last with log-inclusion 0; segmentations that hold less than
1e-13 of a unit's mass together count as none; rows that repeat a key (null included) and text repeat
the result; ``\\u2581`` in a text and every character without a piece are spelled by byte pieces, so
decoding restores every text; columns of the result's names in the input are not read, nor are others.
Very long texts are read whole, ``CHUNK`` characters or one text at a time; time and memory grow in
proportion (about 0.35 ms and 150 bytes a character for an unbroken run without white space)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE_MARK, STAND_IN = "▁", "\ud800"  # the second cannot occur in a text
_UNITS = re.compile(f"\n|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+")
CHUNK = 1 << 21  # characters segmented at once; a longer text is a chunk of its own
SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.uint64(0x0101010101010101)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix_int(x: int) -> int:
    mask = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def _uniform_int(x: int) -> float:
    return ((x >> 12) + 0.5) / (1 << 52)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 52 bits."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


class Model:
    """A SentencePiece model's pieces as arrays: hash tables for lookup, weights, bytes."""

    def __init__(self, path: str | None = None, theta: float = 1.0):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        ranked = all(scores[i] <= 0 and scores[i] == int(scores[i]) for i in plain)
        self.weight = np.full(n, -np.inf)
        self.weight[plain] = -np.log(1 - scores[plain]) * theta if ranked else scores[plain] * theta
        self.byte_weight = float(self.weight[plain].min() - 1)
        self.longest = max(len(pieces[i]) for i in plain)
        self.length = np.array([len(x) for x in pieces], np.int64)
        spelled = [b"" for _ in range(n)]
        for i in range(n):
            if sp.is_byte(i):
                spelled[i] = bytes([int(pieces[i][3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                spelled[i] = pieces[i].replace(SPACE_MARK, " ").encode()
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        plain_text = {pieces[i] for i in plain}
        if any(c not in plain_text for x in plain_text for c in x) or any(SPACE_MARK in x.lstrip(SPACE_MARK) or "\n" in x[1:] for x in plain_text):
            raise ValueError("a piece without a piece for each of its characters, or white space inside a piece")
        self.size = np.array([len(b) for b in spelled], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)[:-1]]
        self.scale = -float(np.mean(self.weight[plain])) / 3  # keeps forward sums near 1
        self._tables(plain, pieces)

    def _tables(self, plain: list[int], pieces: list[str], bits: int = 18) -> None:
        keys = {}
        for i in plain:
            h = 0
            for c in pieces[i]:
                h = (h * int(_GOLD) + ord(c) + 1) & (1 << 64) - 1
            keys[h * 32 + len(pieces[i]) & (1 << 64) - 1] = i
        assert len(keys) == len(plain)
        self.tables, self.bits, left = [], bits, keys
        for t in range(16):
            key, val, more = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), {}
            factor = int(_mix(np.array([t + 1], np.uint64))[0]) | 1
            for k, i in left.items():
                slot = (k * factor & (1 << 64) - 1) >> 64 - bits
                if val[slot] < 0:
                    key[slot], val[slot] = k, i
                else:
                    more[k] = i
            self.tables.append((np.uint64(factor), key, val))
            if not t:  # most strings are no pieces: one look at this map of slots tells
                self.known = np.zeros(1 << 20, bool)
                self.known[[(k * factor & (1 << 64) - 1) >> 44 for k in keys]] = True
            left = more
            if not left:
                return
        raise ValueError("the pieces do not fit the tables")

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the strings are pieces, and their ids."""
        at = np.flatnonzero(self.known[(keys * self.tables[0][0]) >> np.uint64(44)])
        keys = keys[at]
        out = np.full(len(keys), -1, np.int32)
        for factor, key, val in self.tables:
            slot = (keys * factor) >> np.uint64(64 - self.bits)
            hit = key[slot] == keys
            out[hit] = val[slot[hit]]
        hit = out >= 0
        return at[hit], out[hit]

    def units(self, text: str) -> list[str]:
        """The text's independent stretches, a space mark before its start."""
        if not text:
            return []
        if SPACE_MARK in text:
            text = text.replace(SPACE_MARK, STAND_IN)
        return _UNITS.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))

    def decode(self, ids: np.ndarray) -> str:
        n = self.size[ids]
        total = int(n.sum())
        if not total:
            return ""
        take = np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        return self.blob[take].tobytes()[1:].decode(errors="replace")


class Lattices:
    """Forward sums of distinct units, and paths drawn backwards through them.

    Nodes are numbered by place (0 before the first character), then by unit, longest units first, so
    that the nodes of one place, and those any number of characters before them, are slices."""

    def __init__(self, model: Model, units: list[str]):
        self.model, m = model, model.longest
        size = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-size, kind="stable")
        ordered, self.size = [units[i] for i in order.tolist()], size[order]
        self.rank = np.empty(len(units), np.int64)
        self.rank[order] = np.arange(len(units))
        joined = np.frombuffer(("\0" + "\0".join(ordered)).encode("utf-32-le", "surrogatepass"), np.uint32)
        base = np.r_[0, np.cumsum(self.size + 1)[:-1]]
        places = int(self.size[0]) + 1 if len(units) else 0
        live = np.searchsorted(-self.size, -np.arange(places), side="right")
        self.off = np.r_[0, np.cumsum(live)]
        n = int(self.off[-1])
        self.chars = np.zeros(n, np.int64)
        self.ids = np.full((n, m), -1, np.int32)
        self.flat_ids = self.ids.reshape(-1)
        self.total = np.zeros(n)
        self.cumulative = np.full((n, -(-m // 8) * 8), 2.0, np.float32)  # rows of whole 8-byte words as flags
        chance, stretch = np.exp(model.weight), np.exp(model.scale * np.arange(1, m + 1))
        # Sums are kept near 1: ``offset`` is what they were divided by, ``raised`` what they were raised by,
        # model.scale for a character with a piece and its whole weight for one spelled in bytes. A piece
        # never holds such a character, so a piece of i characters is always raised by i * model.scale.
        sums, offset, hashes = [np.ones(len(units))], np.zeros(len(units)), [np.zeros(len(units), np.uint64)]
        raised = np.zeros(len(units))
        self.has_spelled = False
        for p in range(1, places):
            k, w, at = int(live[p]), min(p, m), int(self.off[p])
            char = joined[base[:k] + p]
            code = char.astype(np.uint64) + np.uint64(1)
            # Of the strings of 1, 2, ... characters that end here: hashes, and which are pieces.
            hashes = [np.zeros(k, np.uint64)] + [h[:k] * _GOLD + code for h in hashes[:m]]
            keys = np.concatenate([h * np.uint64(32) + np.uint64(i + 1) for i, h in enumerate(hashes[1 : w + 1])])
            hit, piece = model.lookup(keys)
            length, row = hit // k, hit % k
            self.ids[at + row, length] = piece
            scaled = np.zeros((w, k))
            scaled[length, row] = chance[piece] * stretch[length]
            spelled = np.flatnonzero(self.ids[at : at + k, 0] < 0)
            char = np.where(char == 0xD800, 0x2581, char)
            raised[:k] += model.scale
            if len(spelled):  # characters without a piece
                self.has_spelled = True
                scaled[0, spelled] = 1.0
                raised[spelled] -= model.scale + _width(char[spelled]) * model.byte_weight
            self.chars[at : at + k] = char
            for i in range(w):
                scaled[i] *= sums[-1 - i][:k]
            np.cumsum(scaled, axis=0, out=scaled)
            whole = scaled[-1].copy()
            self.total[at : at + k] = np.log(whole) + offset[:k] - raised[:k]
            self.cumulative[at : at + k, :w] = (scaled / whole).T
            sums.append(whole)
            del sums[:-m]
            if p % 8 == 0:  # the last sums are all that later ones use; bring them back to 1
                sums = [x[:k] / whole for x in sums]
                offset[:k] += np.log(whole)

    def edges(self, rank: int, place: int) -> dict[int, tuple[float, int]]:
        """Length -> chance and piece of the edges into one node."""
        total, node, weight = self.total, int(self.off[place]) + rank, self.model.weight
        end, row = total.item(node), self.ids[node]
        back = lambda length: total.item(int(self.off[place - length]) + rank)
        own = {}
        if row[0] < 0:
            code = self.chars.item(node)
            own[1] = (math.exp(back(1) + float(_width(np.array(code))) * self.model.byte_weight - end), -1 - code)
        for i in np.flatnonzero(row >= 0).tolist():
            own[i + 1] = (math.exp(back(i + 1) + weight.item(row.item(i)) - end), row.item(i))
        return own

    def draw(self, units: np.ndarray, keys: np.ndarray):
        """A path for each unit: its pieces in order (-1 - code for a character that is spelled in
        bytes), where each unit's pieces begin, and each unit's log-probability."""
        rank = self.rank[units]
        place, live, k, r = self.size[rank], np.arange(len(units)), keys, rank
        end = self.off[place] + rank
        count, steps = np.zeros(len(units), np.int64), []
        while len(live):
            # 24 bits of the mixed key times an odd number that differs from step to step
            bits = (k * np.uint64((2 * len(steps) + 1) * int(_GOLD) & (1 << 64) - 1)) >> np.uint64(40)
            chance = bits.astype(np.float32) * np.float32(2.0**-24 * (1 - 2.0**-20))
            node = self.off[place] + r
            flags = (self.cumulative[node] <= chance[:, None]).view(np.uint64)
            before = ((flags * _ONES) >> np.uint64(56)).astype(np.int64).sum(axis=1)  # bytes added up
            piece = self.flat_ids[node * self.model.longest + before]
            if self.has_spelled:
                piece = np.where(piece < 0, -1 - self.chars[node], piece)
            count[live] += 1
            steps.append((live, piece))
            place = place - before - 1
            more = np.flatnonzero(place)
            place, live, k, r = place[more], live[more], k[more], r[more]
        first = np.r_[0, np.cumsum(count)]
        pieces = np.empty(first[-1], np.int64)
        for turn, (live, piece) in enumerate(steps):
            pieces[first[live] + count[live] - 1 - turn] = piece
        # The steps' log-chances telescope to the pieces' weights less the unit's log-mass.
        weight = np.add.reduceat(self.weigh(pieces), first[:-1]) if len(pieces) else np.zeros(0)
        return pieces, first, np.minimum(weight - self.total[end], 0.0)

    def weigh(self, pieces: np.ndarray) -> np.ndarray:
        out = self.model.weight[np.maximum(pieces, 0)]
        odd = np.flatnonzero(pieces < 0)
        if len(odd):
            out[odd] = _width(-1 - pieces[odd]) * self.model.byte_weight
        return out

    def draw_other(self, unit: int, taken: list[tuple[int, ...]], key: int):
        """A path of the unit that is none of ``taken`` (edge lengths from the end), from the
        distribution without them; None if there is no other."""
        rank = int(self.rank[unit])
        place, path, logp, turn = int(self.size[rank]), [], 0.0, 0
        known: dict[int, dict[int, tuple[float, int]]] = {}

        def edges(x: int) -> dict[int, tuple[float, int]]:
            if x not in known:
                known[x] = self.edges(rank, x)
            return known[x]

        def chance_of(x: int, lengths: tuple[int, ...]) -> float:
            out = 1.0
            for length in lengths:
                out *= edges(x)[length][0]
                x -= length
            return out

        while place:
            free = {length: c for length, (c, _) in edges(place).items()}
            for t in taken:
                free[t[turn]] -= chance_of(place, t[turn:])
            free = {length: c for length, c in free.items() if c > 1e-13}
            if not free:
                return None
            left = _uniform_int(_mix_int(key + (turn + 1) * int(_GOLD) & (1 << 64) - 1)) * sum(free.values())
            for length, c in free.items():  # noqa: B007
                left -= c
                if left < 0:
                    break
            chance, piece = edges(place)[length]
            logp += math.log(chance)
            path.append(piece)
            taken = [t for t in taken if t[turn] == length]
            place -= length
            turn += 1
        return np.array(path[::-1], np.int64), min(logp, 0.0)

    def spell(self, pieces: np.ndarray) -> np.ndarray:
        """The piece ids of a path."""
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces.astype(np.int32)
        code = -1 - pieces[odd]
        if (code < 0x80).all():
            out = pieces.astype(np.int32)
            out[odd] = self.model.byte_id[code]
            return out
        count = np.ones(len(pieces), np.int64)
        count[odd] = _width(code)
        first = np.cumsum(count) - count
        out = np.repeat(pieces, count)
        for i, c in zip(first[odd].tolist(), code.tolist()):
            spelled = chr(c).encode()
            out[i : i + len(spelled)] = self.model.byte_id[list(spelled)]
        return out.astype(np.int32)


def _width(code: np.ndarray) -> np.ndarray:
    """Bytes of characters in UTF-8."""
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def _log_rest(logp: np.ndarray) -> np.ndarray:
    """log(1 - exp(logp))."""
    gone = -np.expm1(logp)
    return np.where(gone > 1e-13, np.log(np.maximum(gone, 1e-300)), -np.inf)


def _truncated(mass: np.ndarray, bound: float, keys: np.ndarray) -> np.ndarray:
    """Gumbels of location ``mass`` below ``bound``."""
    log_e = np.log(-np.log(_uniform(_mix(keys))))
    return np.where(np.isfinite(mass), -np.logaddexp(-bound, log_e - mass), -np.inf)


class _Text:
    """The search over one text's segmentations."""

    def __init__(self, units: np.ndarray, key: int):
        self.units, self.key = units, key
        self.keys = _mix(np.uint64(key) + np.arange(1, len(units) + 1, dtype=np.uint64) * _GOLD)
        self.paths: list[tuple] = []  # pieces, first piece of each unit, logp of each unit
        self.scores: list[tuple[float, float]] = []  # log-probability, perturbed
        self.spaces: list[list] = []  # path, first unit, perturbed maxima, taken at the first unit

    def sampled(self, sample: int) -> np.ndarray:
        return self.keys ^ np.uint64(_mix_int((sample + 1) * int(_GOLD) & (1 << 64) - 1))

    def begin(self, path: tuple) -> None:
        best = -math.log(-math.log(_uniform_int(_mix_int(self.key + 17 & (1 << 64) - 1))))
        self.paths.append(path)
        self.scores.append((float(path[2].sum()), best))
        self.split(0, 0, best, [])

    def seg(self, path: tuple, j: int, model: Model) -> tuple[int, ...]:
        """Lengths of the unit's pieces, from its end."""
        return tuple(1 if p < 0 else int(model.length[p]) for p in path[0][path[1][j] : path[1][j + 1]][::-1].tolist())

    def split(self, index: int, start: int, bound: float, taken: list) -> None:
        path = self.paths[index]
        logp = path[2]
        before = (np.cumsum(logp) - logp)[start:]
        rest = _log_rest(logp[start:])
        if taken and len(rest):
            left = 1 - float(np.exp(logp[start])) - sum(p for _, p in taken)
            rest[0] = np.log(left) if left > 1e-12 else -np.inf
        maxima = _truncated(before + rest, bound, self.sampled(index)[start:] + np.uint64(3))
        self.spaces.append([index, start, maxima, taken])

    def best(self) -> tuple[float, int]:
        tops = [float(s[2].max()) if len(s[2]) else -np.inf for s in self.spaces]
        at = int(np.argmax(tops)) if tops else 0
        return (tops[at] if tops else -np.inf), at

    def next(self, lattices: Lattices):
        """Where the next path leaves a known one, and its edges there; None at the end."""
        while True:
            value, at = self.best()
            if value == -np.inf:
                return None
            index, start, maxima, taken = self.spaces[at]
            j = int(np.argmax(maxima))
            maxima[j] = -np.inf
            unit, path = start + j, self.paths[index]
            gone = [(self.seg(path, unit, lattices.model), float(np.exp(path[2][unit])))] + (taken if j == 0 else [])
            sample = len(self.paths)
            other = lattices.draw_other(int(self.units[unit]), [t for t, _ in gone], int(self.sampled(sample)[unit]))
            if other is not None:
                return index, unit, value, gone, other

    def add(self, found: tuple, tail: tuple) -> None:
        index, unit, value, gone, (pieces, logp) = found
        old, (t_pieces, t_first, t_logp) = self.paths[index], tail
        cut, join = int(old[1][unit]), np.concatenate
        self.paths.append((
            join((old[0][:cut], pieces, t_pieces)), join((old[1][: unit + 1], cut + len(pieces) + t_first)), join((old[2][:unit], (logp,), t_logp)),
        ))
        self.scores.append((float(self.paths[-1][2].sum()), value))
        self.split(len(self.paths) - 1, unit, value, gone)


def numbered(split: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct units, and each text's units as places among them. There is a unit without characters
    too, so that no array is empty."""
    flat = list(chain.from_iterable(split))
    try:
        coded = pa.array(flat, pa.string()).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    except (UnicodeError, pa.ArrowInvalid):  # STAND_IN is no character
        index: dict[str, int] = {}
        codes = np.fromiter((index.setdefault(u, len(index)) for u in flat), np.int64, len(flat))
        distinct = list(index)
    return [*distinct, ""], np.split(codes, np.cumsum([len(s) for s in split])[:-1]) if split else []


def segment(model: Model, keys: list[int], texts: list[str], k: int):
    """For each text a list of (ids, log-probability, perturbed, log-inclusion)."""
    distinct, number = numbered([model.units(t) for t in texts])
    lattices = Lattices(model, distinct)
    states = [_Text(u, key) for u, key in zip(number, keys)]

    def draw_many(wanted: list[tuple[_Text, int, int]]) -> list[tuple]:
        """Fresh paths for the units from ``start`` of each text, in one go."""
        units = np.concatenate([s.units[start:] for s, start, _ in wanted])
        keys = np.concatenate([s.sampled(sample)[start:] for s, start, sample in wanted])
        pieces, first, logp = lattices.draw(units, keys)
        out, at = [], 0
        for s, start, _ in wanted:
            n = len(s.units) - start
            a, b = first[at], first[at + n]
            out.append((pieces[a:b], first[at : at + n + 1] - a, logp[at : at + n]))
            at += n
        return out

    if states:
        for s, path in zip(states, draw_many([(s, 0, 0) for s in states])):
            s.begin(path)
    live = states
    for sample in range(1, k):
        found = [(s, f) for s in live if (f := s.next(lattices))]
        if not found:
            break
        for (s, f), tail in zip(found, draw_many([(s, f[1] + 1, sample) for s, f in found])):
            s.add(f, tail)
        live = [s for s, _ in found]
    out = []
    for s in states:
        limit = s.best()[0]
        rows = []
        for (pieces, _, _), (logp, perturbed) in zip(s.paths, s.scores):
            if limit == -np.inf:
                inclusion = 0.0
            else:
                x = logp - limit
                inclusion = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))
            rows.append((lattices.spell(pieces), logp, perturbed, inclusion))
        out.append(rows)
    return out


def _row_key(key, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("null" if key is None else str(key), seed)


def _chunks(batch: pa.RecordBatch, chunk: int) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        keys.append(key.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= chunk or len(texts) >= 4096:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def encode_samples(df: DataFrame, k: int = 2, theta: float = 1.0, seed: int = 42, model: str | None = None, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Up to ``k`` rows for each row of ``df``: doc_id, sample (0 is the perturbed best), ids,
    log_prob, perturbed, log_inclusion, and ``exact``: whether the ids decode to the text. A smaller ``chunk``
    (characters segmented at once; the results are the same) takes less memory and more time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Model(model, theta)
        for batch in batches:
            for keys, texts in _chunks(batch, chunk):
                rows = segment(loaded, [_row_key(x, seed) for x in keys], texts, k)
                flat = [(x, i, t, *r) for x, t, many in zip(keys, texts, rows) for i, r in enumerate(many)]
                ids = [r[3] for r in flat]
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                     *[pa.array([r[c] for r in flat], pa.float64()) for c in (4, 5, 6)],
                     pa.array([loaded.decode(r[3]) == r[2] for r in flat], pa.bool_())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")] + ["exact"],
                )

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, f"{SCHEMA}, exact boolean")


def decode(df: DataFrame, model: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` plus the text of its piece ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Model(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x.as_py() is None else loaded.decode(np.asarray(x.values)) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{schema}, `{out}` string")


def digested(samples: DataFrame) -> DataFrame:
    """The samples with their ids as a count and a hash."""
    return samples.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxh64"),
        F.round("log_prob", 6).alias("log_prob"), F.round("perturbed", 6).alias("perturbed"),
        F.round("log_inclusion", 6).alias("log_inclusion"), "exact",
    )


def op6_gumbel_lattice(spark, sf_dir: str) -> DataFrame:
    return digested(encode_samples(table(spark, sf_dir, "documents")))
