"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 11
BATCH_CHARS = 2 << 20  # characters of the texts that are encoded together, if there is more than one
CHUNK = 1 << 17  # characters of the words whose agendas are worked off together
SPACE = "▁"
SHORT = WIDTH = 128  # characters; longer words are merged one by one
NONE = (1 << 31) - WIDTH  # cost of no candidate, with room for a place below it
_MASK, _STEP, _BITS = (1 << 64) - 1, 0x9E3779B97F4A7C15, 53


class Pieces:
    """Vocabulary of a merge-type model: piece -> rank, ids, byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces, so it cannot decode without loss")
        plain = [i for i in range(size) if not special[i] and not model.is_byte(i)]
        self.ids = {self.text[i]: i for i in plain}
        self.cost = {self.text[i]: -model.get_score(i) for i in plain}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}


def mixed(x):
    """splitmix64 of a counter, for Python integers and for uint64 arrays alike."""
    if isinstance(x, np.ndarray):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def skipped(key: int, left: int, stop: int, limit: int) -> bool:
    """Whether a word with this key skips the candidate over left:stop; every candidate has a draw of its own."""
    return mixed(key + (left << 32 | stop) * _STEP & _MASK) >> 64 - _BITS < limit


def merged(word: str, pieces: Pieces, limit: int = 0, key: int = 0, done: list[int] | None = None) -> list[int]:
    """Ids of one word; the spans merged are added to `done` in order.

    The agenda holds every pair of neighbours that forms a piece, best score first, then leftmost.  A candidate
    is skipped for good if its draw falls below the dropout; other candidates may still cover the span.
    Characters that end up outside the vocabulary become their bytes.
    """
    symbols = (_short if len(word) <= SHORT else _long)(word, pieces.cost.get, limit, key, [] if done is None else done)
    out, ids = [], pieces.ids
    for piece in symbols:
        found = ids.get(piece)
        if found is None:
            out.extend(pieces.byte[b] for b in piece.encode("utf-8", "surrogatepass"))
        else:
            out.append(found)
    return out


def _short(word: str, find, limit: int, key: int, done: list[int]) -> list[str]:
    """The agenda as a list of costs by place: for a few candidates the least is found faster than in a heap."""
    symbols, none = list(word), float("inf")
    ends = list(range(1, len(word) + 1))
    costs = [find(a + b, none) for a, b in zip(symbols, symbols[1:])]
    while costs:
        low = min(costs)
        if low == none:
            break
        i = costs.index(low)
        left = ends[i - 1] if i else 0
        if limit and skipped(key, left, ends[i + 1], limit):
            costs[i] = none
            continue
        done.append(left << 32 | ends[i + 1])
        symbols[i] = joined = symbols[i] + symbols[i + 1]
        del symbols[i + 1], ends[i], costs[i]
        if i < len(costs):
            costs[i] = find(joined + symbols[i + 1], none)
        if i:
            costs[i - 1] = find(symbols[i - 1] + joined, none)
    return symbols


def _long(word: str, find, limit: int, key: int, done: list[int]) -> list[str]:
    """The agenda as a heap; the same merges in the same order."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the symbol that starts here; 0 once merged away
    before = list(range(-1, n - 1))
    agenda = [(cost, i, i + 1, i + 2) for i in range(n - 1) if (cost := find(word[i : i + 2])) is not None]
    heapify(agenda)
    while agenda:
        _, left, middle, stop = heappop(agenda)
        if end[left] != middle or end[middle] != stop:
            continue
        if limit and skipped(key, left, stop, limit):
            continue
        done.append(left << 32 | stop)
        end[left], end[middle] = stop, 0
        if stop < n:
            before[stop] = left
            cost = find(word[left : end[stop]])
            if cost is not None:
                heappush(agenda, (cost, left, stop, end[stop]))
        if left:
            first = before[left]
            cost = find(word[first:stop])
            if cost is not None:
                heappush(agenda, (cost, first, left, stop))
    out, at = [], 0
    while at < n:
        out.append(word[at : end[at]])
        at = end[at]
    return out


class Merges:
    """The vocabulary as arrays: symbols of characters, pairs of symbols that form a piece, bytes of pieces.

    A symbol is the id of a piece, or `size` plus the code point of a character that is no piece.
    """

    def __init__(self, pieces: Pieces):
        self.size = size = len(pieces.text)
        self.of_char = np.arange(size, size + 0x110000, dtype=np.int32)
        for piece, i in pieces.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        symbol = lambda part: int(self.of_char[ord(part)]) if len(part) == 1 else pieces.ids.get(part)
        found = [
            (left << 32 | right, i)
            for piece, i in pieces.ids.items()
            for at in range(1, len(piece))
            if (left := symbol(piece[:at])) is not None and (right := symbol(piece[at:])) is not None
        ]
        self._fill(*np.array(found, np.int64).reshape(-1, 2).T)
        costs = [pieces.cost.get(t, 0.0) for t in pieces.text]
        self.rank = np.append(np.unique(costs, return_inverse=True)[1] * WIDTH, NONE).astype(np.int32)
        said = [pieces.raw.get(i) or t.replace(SPACE, " ").encode() for i, t in enumerate(pieces.text)]
        self.lengths = np.array([len(t) for t in said])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(said), np.uint8)
        self.byte_ids = np.array([pieces.byte[b] for b in range(256)], np.int32)

    def _fill(self, keys: np.ndarray, joined: np.ndarray) -> None:
        """An open table, at most an eighth full; pairs that meet in a place go to the next free one."""
        self.shift = np.uint64(64 - max(10, int(8 * len(keys)).bit_length()))
        self.keys = np.full((1 << 64 - int(self.shift)) + len(keys), -1, np.int64)
        self.joined = np.full(len(self.keys), -1, np.int32)
        for key, at, i in zip(keys.tolist(), self._place(keys).tolist(), joined.tolist()):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.joined[at] = key, i

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_STEP) >> self.shift).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols form, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.joined[at], np.int32(-1))
        more = np.flatnonzero((held != keys) & (held >= 0))
        while len(more):
            at[more] += 1
            held = self.keys[at[more]]
            met = held == keys[more]
            out[more[met]] = self.joined[at[more[met]]]
            more = more[~met & (held >= 0)]
        return out


class Encoder:
    """Encodes whole texts.  One seed gives one result; another seed gives other segmentations.

    A space becomes the space mark and one mark is put before the text, as the model was trained.  No piece
    has the mark behind another character, so words can be merged apart from one another.  A mark that
    stands in the text itself is written as bytes, which keeps it apart from a space.
    """

    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces = Pieces(path)
        self.merges = Merges(self.pieces)
        self.limit, self.seed = int(dropout * (1 << _BITS)), seed
        self.memory: frozenset[str] = frozenset()  # words remembered between texts: none

    def starts(self, keys: np.ndarray) -> np.ndarray:
        """From the key of a text what the keys of its words start from."""
        return mixed(np.uint64(mixed(self.seed & _MASK)) + keys.astype(np.int64).view(np.uint64) * np.uint64(_STEP))

    def word_keys(self, key: int, n: int) -> np.ndarray:
        """Keys of the first n word places of the text with this key."""
        return mixed(self.starts(np.array([key])) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP))

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        """Ids of the whole text; a candidate's draw is keyed by the seed, `key`, the word's place and the span."""
        return self.encode_all([text], [key])[0]

    def encode_all(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and their numbers; the words of all texts are merged side by side."""
        whole = "".join([" " + t for t in texts if t])
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        space, mark = codes == ord(" "), codes == ord(SPACE)
        symbols = self.merges.of_char[np.where(space, np.uint32(ord(SPACE)), codes)]
        symbols[mark] = self.merges.size + ord(SPACE)
        # A word is a run of spaces with what follows; a mark of the text stands alone and is not counted.
        first = mark | space
        first[1:] &= ~(space[1:] & space[:-1])
        first[1:] |= mark[:-1]
        begins = np.array([e - len(t) - 1 for t, e in zip(texts, ends.tolist()) if t])
        first[begins] = True
        at = np.flatnonzero(first)
        size = np.diff(at, append=len(codes))
        counted = ~mark[at]
        number = np.cumsum(counted)
        text = np.searchsorted(ends, at, "right")
        before = np.zeros(len(texts), np.int64)
        heads = np.searchsorted(at, begins)
        before[text[heads]] = number[heads] - counted[heads]
        places = (number - before[text]).astype(np.uint64)
        word_keys = mixed(self.starts(np.array(keys, np.int64))[text] + places * np.uint64(_STEP))
        drawn = self._merged(whole, symbols, at, size, word_keys)
        lengths = np.diff(np.cumsum(np.append(0, drawn >= 0))[ends], prepend=0)
        ids = drawn[drawn >= 0]
        foreign = np.flatnonzero(ids >= self.merges.size)
        if len(foreign):
            ids, lengths = self._as_bytes(ids, foreign, lengths)
        return ids, lengths

    def _as_bytes(self, ids: np.ndarray, foreign: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become their bytes."""
        codes = (ids[foreign] - self.merges.size).astype(np.uint32)
        said = codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        size = np.ones(len(ids), np.int64)
        size[foreign] += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        places = np.cumsum(size)
        kept = np.zeros(len(ids), bool)
        kept[foreign] = True
        out, byte = np.repeat(ids, size), np.repeat(kept, size)
        out[byte] = self.merges.byte_ids[np.frombuffer(said, np.uint8)]
        return out, np.diff(np.append(0, places)[np.cumsum(lengths)], prepend=0)

    def _merged(self, whole: str, symbols: np.ndarray, at: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The symbols after all merges, each where it begins; -1 where one has been merged into that before it."""
        n = len(symbols)
        live = np.append(symbols, np.int32(0))
        pairs = np.append(self.merges.pair(symbols[:-1], symbols[1:]), np.int32(-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        order = np.argsort(size, kind="stable")
        lo = int(np.searchsorted(size[order], 2))
        last = int(np.searchsorted(size[order], SHORT, "right"))
        while lo < last:
            width = int(size[order[lo]])
            hi = min(last, int(np.searchsorted(size[order], width + width // 8, "right")), lo + max(64, CHUNK // width))
            words = order[lo:hi]
            self._agendas(live, pairs, after, before, at[words], size[words], keys[words])
            lo = hi
        for w in order[last:].tolist():
            begin, stop, done = int(at[w]), int(at[w] + size[w]), []
            word = whole[begin:stop].replace(" ", SPACE)
            _long(word, self.pieces.cost.get, self.limit, int(keys[w]), done)
            for span in done:  # a later span covers the earlier ones
                left, right = span >> 32, span & 0xFFFFFFFF
                live[begin + left : begin + right] = -1
                live[begin + left] = self.pieces.ids[word[left:right]]
        return live[:-1]

    def _agendas(
        self, live: np.ndarray, pairs: np.ndarray, after: np.ndarray, before: np.ndarray,
        at: np.ndarray, size: np.ndarray, keys: np.ndarray,
    ) -> None:
        """One agenda a word, a step of all at once: its best candidate, leftmost of equals, is merged or skipped.

        `live` has the symbols by the place of their first character, `pairs` the piece that a symbol forms with the
        next, `after` and `before` the places of its neighbours.  An agenda is a column of costs by place in the word.
        """
        place = np.arange(size.max(), dtype=np.int32)[:, None]
        end = at + size
        # The last pair of a word reaches into the next word; shorter words do so beyond their last symbol as well.
        inside = place < size.astype(np.int32) - 1
        rank, pair = self.merges.rank, self.merges.pair
        where = np.minimum(at + place, len(pairs) - 1)
        costs = np.where(inside, rank[pairs[where]], NONE) | place
        while True:
            low = costs.min(axis=0)
            on = np.flatnonzero(low < NONE)
            if not len(on):
                return
            if len(on) < 0.8 * len(low):
                costs, low, at, end, keys = costs[:, on], low[on], at[on], end[on], keys[on]
                on = np.arange(len(on))
            place = low[on] & (WIDTH - 1)
            here = at[on] + place
            middle = after[here]
            stop = after[middle]
            if self.limit:
                span = place.astype(np.uint64) << np.uint64(32) | (stop - at[on]).astype(np.uint64)
                skips = mixed(keys[on] + span * np.uint64(_STEP)) >> np.uint64(64 - _BITS) < np.uint64(self.limit)
                costs[place[skips], on[skips]] = NONE
                goes = ~skips
                on, place, here, middle, stop = on[goes], place[goes], here[goes], middle[goes], stop[goes]
            begin = at[on]
            made = pairs[here]
            live[here], live[middle] = made, -1
            after[here], before[stop] = stop, here
            costs[middle - begin, on] = NONE
            ahead = pair(made, live[stop])
            ahead[stop >= end[on]] = -1
            pairs[here] = ahead
            costs[place, on] = rank[ahead] | place
            left = np.flatnonzero(place)
            first = before[here[left]]
            behind = pair(live[first], made[left])
            pairs[first] = behind
            place = (first - begin[left]).astype(np.int32)
            costs[place, on[left]] = rank[behind] | place

    def decode(self, ids: np.ndarray) -> str:
        """The text whose encoding this is."""
        return decode(ids.tolist(), self.pieces)

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose encodings these are."""
        sizes = self.merges.lengths[ids]
        ends = np.append(0, np.cumsum(sizes))
        places = np.repeat(self.merges.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        whole = self.merges.bytes[places].tobytes()
        cuts = ends[np.append(0, np.cumsum(lengths))].tolist()
        return [whole[a + 1 : b] for a, b in zip(cuts, cuts[1:])]


def decode(ids: list[int], pieces: Pieces) -> str:
    """Pieces joined with marks as spaces, less the first mark; runs of byte pieces read as UTF-8."""
    text, raw = pieces.text, pieces.raw
    if raw.keys().isdisjoint(ids):
        return "".join([text[i] for i in ids]).replace(SPACE, " ")[1:]
    whole = b"".join(raw[i] if i in raw else text[i].replace(SPACE, " ").encode() for i in ids)
    return whole.decode("utf-8", "surrogatepass")[1:]


def parts(rows: pa.RecordBatch, batch: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to `batch` rows and about BATCH_CHARS bytes of text, at least one row each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < rows.num_rows:
        room = (ends[at - 1] if at else 0) + BATCH_CHARS
        stop = min(at + batch, max(at + 1, int(np.searchsorted(ends, room, "right"))))
        yield rows.slice(at, stop - at)
        at = stop


def encode_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    dropout: float = DROPOUT,
    seed: int = SEED,
    batch: int = 256,
) -> DataFrame:
    """One row per input row: id, `ids` (array<int>), `n_tokens`, `lossless` (decoding gives the text back).

    A null text counts as empty and has no tokens.  What merges a word skips depends on the seed, the hash of
    the id and the word's place, so reruns and other partitionings agree.  The vocabulary is read
    by each task from `model`, a path every executor has.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    names = [id_col, "ids", "n_tokens", "lossless"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, dropout, seed)
        for rows in batches:
            for part in parts(rows, batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, lengths = encoder.encode_all(texts, part.column(2).to_pylist())
                lossless = [a == t.encode() for a, t in zip(encoder.decode_all(ids, lengths), texts)]
                ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
                tokens = pa.ListArray.from_arrays(ends, pa.array(ids))
                made = [part.column(0), tokens, pa.array(lengths), pa.array(lossless)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(F.lit(seed), id_col).alias("__key"))
    return rows.mapInArrow(encoded, f"`{id_col}` {kind}, ids array<int>, n_tokens long, lossless boolean")
