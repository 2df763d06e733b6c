"""SentencePiece encoding and decoding by a max-plus parallel scan over chunks.

A segmentation is a path through a lattice of character positions.  A text is cut
into chunks of ``CHUNK_CHARS`` characters.  A state at a cut is an edge that
crosses it or ends there.  Each chunk, on its own, gives a transfer matrix: the best
score from every state at its start to every state at its end.  Max-plus products
are associative: the matrices of ``BLOCK_CHUNKS`` chunks are combined to one, a scan
over a document's blocks gives the states at their ends, a scan within each block
those at its cuts, and each chunk is then traced back on its own between its two
states.  A text of one chunk has one state at either end and is traced at once.

Unigram models: the edges are the vocabulary's pieces with their scores (and
unknown characters with the library's penalty), so the scan is the Viterbi search;
the state is how far the edge reaches beyond the cut.  Of segmentations with equal
scores it may take another one than the library.

BPE models: the edges are the pieces, too, and a path is the library's segmentation
if, and only if, the library keeps every two neighbours of it apart: a merge across
a boundary would show in the two pieces beside it.  The score is 0 for such a path,
and minus infinity for others; a document has one path.  The state is the piece
around the cut (characters before and after it), as its successor depends on it.
Where no piece of the vocabulary has the two characters side by side, every path
has a boundary, so a matrix only needs the stretches between a cut and the nearest
such place.  Between two states the library encodes the chunk.  The ids equal those
of a whole call.

Cases: a null or empty text has no pieces; a lone U+2581 is decoded as a space, as
the library does, and such a text counts as changed; repeated rows and doc_ids are
encoded once a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import memory
from .common import shuffle_partitions, stage, table

CHUNK_CHARS = 1 << 15
BLOCK_CHUNKS = 64
MEMO_PAIRS = 300_000
MEMO_WORDS = 1_000_000
MEMO_CHARS = 48
SPACE = "▁"
#: Fixed values of the model format: kinds of model and piece, and what an unknown character costs.
UNIGRAM, BPE = 1, 2
USER_DEFINED, UNUSED = 4, 5
UNKNOWN_PENALTY = 10.0
NEVER = -np.inf

_OPEN: dict[str, "PieceModel"] = {}
memory.register("pieces", _OPEN.clear)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if path else sentencepiece.SentencePieceProcessor(model_proto=proto)
        top = list(_fields(self.library.serialized_model_proto()))
        special = any(self._kind_of(part) in (USER_DEFINED, UNUSED) for f, part in top if f == 1)
        self.kind = next((v for f, part in top if f == 2 for g, v in _fields(part) if g == 3), UNIGRAM)
        normalizer = dict(x for f, part in top if f == 3 for x in _fields(part))
        ids = range(self.library.vocab_size())
        ordinary = [i for i in ids if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        pieces = {self.library.id_to_piece(i): i for i in ordinary}
        self.scores = {p: (self.library.get_score(i), i) for p, i in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        self.inside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.unknown = min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.prefix = bool(normalizer.get(3, 1))
        self.bytes_of = {b: self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        # Stretches are encoded behind a line break, which must never join another character.
        lone = len(self.library.encode("\n")) == 1 + self.prefix and not any("\n" in p for p in pieces)
        plain = normalizer.get(1) == b"identity" and not normalizer.get(4, 1)
        self.cuts = plain and lone and not special and self.kind in (UNIGRAM, BPE)

        # A word may be encoded alone if nothing but a space joins the start of a word, and remembered.
        self.words_apart = self.cuts and self.kind == BPE and self.prefix and all(x[0] == SPACE for x in self.inside if x[1] == SPACE)
        self._memo: dict[str, bytes] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        self._spelled = [self._spell(i) for i in ids]

    @staticmethod
    def _kind_of(piece: bytes) -> int | bytes:
        return next((v for f, v in _fields(piece) if f == 3), 1)

    def _spell(self, i: int) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(self.library.id_to_piece(i)[3:5], 16)])
        if self.library.is_unknown(i):
            return " ⁇ ".encode()
        return b"" if self.library.is_control(i) else self.library.id_to_piece(i).replace(SPACE, " ").encode()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers; words that were seen before are looked up."""
        if not text or not self.words_apart or "  " in text or " \n" in text or SPACE in text or text[0] in " \n" or text[-1] == " ":
            return array("I", self.library.encode(text)).tobytes()
        words, memo = text.replace("\n", " \n").split(" "), self._memo
        if fresh := list(set(words).difference(memo)):
            if len(memo) > MEMO_WORDS:
                memo.clear()
                fresh = list(set(words))
            for w, ids in zip(fresh, self.library.encode(fresh, num_threads=1), strict=True):
                # A line break follows its word without a space: the library's own prefix goes.
                memo[w] = array("I", ids[1:] if w[:1] == "\n" else ids).tobytes()
        out = b"".join(map(memo.__getitem__, words))
        for w in fresh:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    def decode(self, ids: list[int], first: bool) -> str:
        """The text of ids; only the first part of a document has the prefix."""
        raw = b"".join(map(self._spelled.__getitem__, ids))
        return (raw[1:] if first and self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def marked(self, text: str) -> str:
        """The text as the lattice has it, with its blanks as they are."""
        return (SPACE if self.prefix else "") + text

    def node(self, text: str, at: int) -> bool:
        """No piece crosses this place."""
        return at <= 0 or at >= len(text) or text[at - 1 : at + 1] not in self.inside

    def chunks(self, text: str, size: int) -> Iterator[tuple[str, int, int]]:
        """(chunk with what its edges may reach, characters before it, its length)."""
        before = self.longest if self.kind == BPE else 0
        for at in range(0, len(text), size):
            stop = min(at + size, len(text))
            yield text[max(0, at - before) : stop + self.longest - 1], min(at, before), stop - at

    def _edges(self, text: str, at: int, limit: int) -> Iterator[tuple[int, float, int]]:
        """(end, score, id) of the edges from ``at``; -1 is an unknown character."""
        known = False
        for n in range(1, min(self.longest, limit - at) + 1):
            if hit := self.scores.get(text[at : at + n]):
                known |= n == 1
                yield at + n, hit[0], hit[1]
        if not known and at < limit:
            yield at + 1, self.unknown, -1

    def stretch_ids(self, stretch: str) -> list[int]:
        """The library's ids of a stretch alone, without a prefix."""
        return self.library.encode("\n" + stretch.replace(SPACE, " "))[1 + self.prefix :] if stretch else []

    def apart(self, first: str, second: str) -> bool:
        """The library keeps two pieces, or one and nothing, as they are when they stand alone."""
        if (known := self._apart.get((first, second))) is None:
            if len(self._apart) > MEMO_PAIRS:
                self._apart.clear()
            one = [i for p in (first, second) if p for i in ([self.scores[p][1]] if p in self.scores else self._unknown(p))]
            known = self._apart[first, second] = self.stretch_ids(first + second) == one
        return known

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """BPE: (characters before, after the cut) of each piece that crosses the place or ends there."""
        found = []
        for back in range(1, min(self.longest, cut) + 1):
            for ahead in range(min(self.longest - back, len(text) - cut) + 1):
                piece = text[cut - back : cut + ahead]
                if (piece in self.scores or len(piece) == 1) and self.apart(piece, ""):
                    found.append((back, ahead))
        return found

    def _reached(self, text: str, begun: dict[int, dict[int, int]], stop: int) -> dict[int, dict[int, int]]:
        """Follow paths up to ``stop``: {end: {start: set of origins}} of the edges there.

        Sets are bits of an integer; ``begun`` has the same form, with a start of -1 for no edge.
        """
        done: dict[int, dict[int, int]] = {}
        while begun:
            at = min(begun)
            here = begun.pop(at)
            if at >= stop:
                done[at] = here
                continue
            free = self.node(text, at)
            for end, _, _ in self._edges(text, at, len(text)):
                piece, origins = text[at:end], 0
                for start, own in here.items():
                    if self.apart(piece, "") if free or start < 0 else self.apart(text[start:at], piece):
                        origins |= own
                if origins:
                    into = begun.setdefault(end, {})
                    into[at] = into.get(at, 0) | origins
        return done

    def transfer(self, text: str, before: int, cut: int) -> np.ndarray:
        """Best scores from each state at the start of a chunk to each at its end."""
        return self._piece_paths(text, before, before + cut) if self.kind == BPE else self._best_paths(text, cut)

    def _best_paths(self, text: str, cut: int) -> np.ndarray:
        text, n = text.replace(" ", SPACE), self.longest
        matrix = np.full((n, n), NEVER)
        best = np.full((len(text) + 1, n), NEVER)
        for d in range(min(n, len(text) + 1)):
            best[d, d] = 0.0
        for at in range(cut):
            if best[at].max() > NEVER:
                for end, score, _ in self._edges(text, at, len(text)):
                    np.maximum(best[end], best[at] + score, out=best[end])
        for d in range(min(n, len(text) - cut + 1)):
            matrix[:, d] = best[cut + d]
        return matrix

    def _ends(self, text: str, begin: int, stop: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """BPE: the states at both ends of a chunk; a document has one at its start and one at its end."""
        return self.states(text, begin) if begin else [(0, 0)], self.states(text, stop) if stop < len(text) else [(0, 0)]

    def _piece_paths(self, text: str, begin: int, stop: int) -> np.ndarray:
        text = text.replace(" ", SPACE)
        enter, leave = self._ends(text, begin, stop)
        begun: dict[int, dict[int, int]] = {}
        for k, (back, ahead) in enumerate(enter):
            begun.setdefault(begin + ahead, {})[begin - back if back else -1] = 1 << k
        inner = range(begin, stop)
        first = next((p for p in inner if self.node(text, p)), None)
        if first is None:
            reached = self._reached(text, begun, stop)
        else:
            # All paths meet at these places: what leads to the first and what leads on from the last is enough.
            last = next(p for p in reversed(inner) if self.node(text, p))
            reached = self._reached(text, {last: {-1: 1}}, stop)
            alive = 0
            for starts in self._reached(text, begun, first).values():
                for origins in starts.values():
                    alive |= origins
        column = {(stop - back, stop + ahead): k for k, (back, ahead) in enumerate(leave)}
        matrix = np.full((len(enter), len(leave)), NEVER)
        for end, starts in reached.items():
            for start, origins in starts.items():
                at = 0 if stop == len(text) else column.get((start, end))
                for k in range(len(enter)):
                    if at is not None and (origins if first is None else alive) >> k & 1:
                        matrix[k, at] = 0.0
        return matrix

    def between(self, text: str, before: int, cut: int, enter: int, leave: int) -> str:
        """What the best path has between two states of a chunk; blanks are as they were."""
        if self.kind == BPE:
            lattice = text.replace(" ", SPACE)
            enters, leaves = self._ends(lattice, before, before + cut)
            enter, leave = enters[enter][1], leaves[leave][1]
        return text[before + enter : before + cut + leave]

    def trace(self, text: str, before: int, cut: int, enter: int, leave: int) -> list[int]:
        """Ids of the best path of a chunk between two states."""
        if self.kind == BPE:
            stretch = self.between(text, before, cut, enter, leave)
            if before:
                return self.stretch_ids(stretch)
            return np.frombuffer(self.encode(stretch[self.prefix :]), np.int32).tolist()
        text = text.replace(" ", SPACE)
        goal = cut + leave
        best, back = np.full(goal + 1, NEVER), [(0, -1)] * (goal + 1)
        best[enter] = 0.0
        for at in range(enter, goal):
            if best[at] > NEVER and at < cut:
                for end, score, piece in self._edges(text, at, goal):
                    if best[at] + score > best[end]:
                        best[end], back[end] = best[at] + score, (at, piece)
        ids: list[int] = []
        at = goal
        while at > enter:
            begin, piece = back[at]
            ids += [piece] if piece >= 0 else self._unknown(text[begin:at])[::-1]
            at = begin
        return ids[::-1]

    def _unknown(self, char: str) -> list[int]:
        ids = [self.bytes_of[b] for b in char.encode()]
        return ids if all(self.library.is_byte(i) for i in ids) else [self.library.unk_id()]


def combine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (first[:, :, None] + second[None, :, :]).max(axis=1)


def states_between(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The states of the best path between two states, at the start, at every cut and at the end."""
    reach = [np.full(matrices[0].shape[0], NEVER)]
    reach[0][enter] = 0.0
    for m in matrices:
        reach.append((reach[-1][:, None] + m).max(axis=0))
    path = [leave]
    for m, before in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
        path.append(int(np.argmax(before + m[:, path[-1]])))
    return path[::-1]


def model_of(path: str) -> PieceModel:
    """One model a worker process and file."""
    memory.claim("pieces")
    if path not in _OPEN:
        _OPEN[path] = PieceModel(path)
    return _OPEN[path]


_ENCODED = "doc_id long, row long, part int, ids array<int>, text string"
_NAMES = ["doc_id", "row", "part", "ids", "text"]
Batches = Iterator[pa.RecordBatch]


def _lists(blobs: list[bytes]) -> pa.Array:
    """Arrays of ids without a Python object an id."""
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def _small(batch: pa.RecordBatch, chars: int = 1 << 19) -> Batches:
    """A batch in slices of about as many bytes of text each."""
    begun = held = 0
    for k, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        held += n or 0
        if held >= chars:
            yield batch.slice(begun, k + 1 - begun)
            begun, held = k + 1, 0
    if begun < batch.num_rows:
        yield batch.slice(begun)


def _encoded(model_path: str) -> Callable[[Batches], Batches]:
    def whole(batches: Batches) -> Batches:
        model = model_of(model_path)
        for large in batches:
            for batch in _small(large):
                n = batch.num_rows
                ids = _lists([model.encode(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int32()), ids, batch.column("text").cast(pa.string())], names=_NAMES)

    return whole


def _whole_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _split(docs: DataFrame, model_path: str, chunk_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Texts to encode whole, and the chunks of the giant ones with their states."""
    rows = _whole_rows(docs)
    if not model_of(model_path).cuts:
        return rows, None
    giant = F.char_length("text") > chunk_chars
    return rows.where(~giant), _chunks_with_states(rows.where(giant), model_path, chunk_chars)


def encode_pieces(docs: DataFrame, model_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, row, part, ids, text: a part has the ids of a stretch of the text, in order within a row."""
    rows, giants = _split(docs, model_path, chunk_chars)
    whole = rows.mapInArrow(_encoded(model_path), _ENCODED)
    return whole if giants is None else whole.unionByName(giants.mapInArrow(_traced(model_path), _ENCODED))


def _matrix_of(rows: int, blob: bytes) -> np.ndarray:
    return np.frombuffer(blob).reshape(rows, -1)


def _grouped(batches: Batches, keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with the same first ``keys`` columns."""
    now, rows = None, []
    for batch in batches:
        for x in batch.to_pylist():
            key = tuple(x.values())[:keys]
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(x)
    if rows:
        yield now, rows


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


_CHUNK = "row long, block int, part int, doc_id long, before int, cut int, stretch string"
_MATRIX = "row long, block int, part int, states int, matrix binary"
_BLOCK = "row long, block int, states int, matrix binary"
_STATES = "row long, part int, enter int, leave int"


def _chunks_with_states(rows: DataFrame, model_path: str, chunk_chars: int) -> DataFrame:
    n_tasks = shuffle_partitions(rows.sparkSession)

    def cut(batches: Batches) -> Batches:
        from pyspark import TaskContext

        model, row = model_of(model_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part, (stretch, before, length) in enumerate(model.chunks(model.marked(text.as_py()), chunk_chars)):
                    yield _batch(_CHUNK, [(row, part // BLOCK_CHUNKS, part, doc_id, before, length, stretch)])
                row += 1

    def matrices(batches: Batches) -> Batches:
        model = model_of(model_path)
        for batch in batches:
            for x in batch.to_pylist():
                matrix = model.transfer(x["stretch"], x["before"], x["cut"])
                yield _batch(_MATRIX, [(x["row"], x["block"], x["part"], len(matrix), matrix.tobytes())])

    def products(batches: Batches) -> Batches:
        for (row, block), found in _grouped(batches, 2):
            product = reduce(combine, [_matrix_of(x["states"], x["matrix"]) for x in found])
            yield _batch(_BLOCK, [(row, block, len(product), product.tobytes())])

    def scan(batches: Batches) -> Batches:
        for (row,), found in _grouped(batches, 1):
            states = states_between([_matrix_of(x["states"], x["matrix"]) for x in found])
            yield _batch("row long, block int, from_state int, to_state int", [(row, x["block"], a, b) for x, a, b in zip(found, states, states[1:])])

    def inside(batches: Batches) -> Batches:
        for (row, _), found in _grouped(batches, 2):
            states = states_between([_matrix_of(x["states"], x["matrix"]) for x in found], found[0]["from_state"], found[0]["to_state"])
            yield _batch(_STATES, [(row, x["part"], a, b) for x, a, b in zip(found, states, states[1:])])

    chunks = stage(rows.mapInArrow(cut, _CHUNK), "piece-chunks")
    found = stage(chunks.select("row", "block", "part", "before", "cut", "stretch").mapInArrow(matrices, _MATRIX), "piece-matrices")
    blocks = found.repartition(n_tasks, "row", "block").sortWithinPartitions("row", "block", "part").select("row", "block", "states", "matrix").mapInArrow(products, _BLOCK)
    ends = blocks.repartition(n_tasks, "row").sortWithinPartitions("row", "block").mapInArrow(scan, "row long, block int, from_state int, to_state int")
    known = found.join(ends, ["row", "block"]).repartition(n_tasks, "row", "block").sortWithinPartitions("row", "block", "part")
    states = known.mapInArrow(inside, _STATES)
    return chunks.join(states, ["row", "part"])


def _traced(model_path: str) -> Callable[[Batches], Batches]:
    def trace(batches: Batches) -> Batches:
        model = model_of(model_path)
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                at = (x["stretch"], x["before"], x["cut"], x["enter"], x["leave"])
                text = model.between(*at)
                yield _batch(_ENCODED, [(x["doc_id"], x["row"], x["part"], model.trace(*at), text[1:] if x["part"] == 0 and model.prefix else text)])

    return trace


def _decoded(model_path: str) -> Callable[[Batches], Batches]:
    def decode(batches: Batches) -> Batches:
        model = model_of(model_path)
        for batch in batches:
            ids, parts = batch.column("ids"), batch.column("part").to_pylist()
            texts = [model.decode(ids[k].values.to_numpy().tolist() if ids[k].is_valid else [], parts[k] == 0) for k in range(batch.num_rows)]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return decode


def decode_pieces(parts: DataFrame, model_path: str) -> DataFrame:
    """Add ``decoded``, the text of each part's ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInArrow(_decoded(model_path), f"{schema}, decoded string")


_DIGEST = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, round_trip boolean"


_POLYNOMIAL = 0xEDB88320  # fixed value of crc32


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32; the top bit is the constant term."""
    product = 0
    for place in range(31, -1, -1):
        if a >> place & 1:
            product ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return product


def joined_crc32(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings on end, from theirs and the second's length."""
    shift, power = 1 << 31, 1 << 23  # 1, and a byte's eight places
    while length:
        if length & 1:
            shift = _times(shift, power)
        power, length = _times(power, power), length >> 1
    return _times(shift, first) ^ second


_PART = "doc_id long, row long, part int, n_chars long, n_pieces long, ids_crc32 long, round_trip boolean"


def _digested(batches: Batches) -> Batches:
    """Per part: characters, pieces, crc32 of their ids, and whether decoding gives the text back."""
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "row", "part", "text", "decoded"))
        for k, (doc_id, row, part, text, decoded) in enumerate(zip(*columns, strict=True)):
            raw = batch.column("ids")[k].values.to_numpy().astype("<i4").tobytes()
            out.append((doc_id, row, part, len(text), len(raw) // 4, zlib.crc32(raw), decoded == text))
        if out:
            yield _batch(_PART, out)


def _whole_digests(batches: Batches) -> Batches:
    for (row,), parts in _grouped(batches, 1):
        crc = 0
        for x in parts:
            crc = joined_crc32(crc, x["ids_crc32"], 4 * x["n_pieces"])
        yield _batch(_DIGEST, [(parts[0]["doc_id"], sum(x["n_chars"] for x in parts), sum(x["n_pieces"] for x in parts), crc, all(x["round_trip"] for x in parts))])


def encode_digests(docs: DataFrame, model_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encode and decode every text; no task gathers the ids of a giant one, only the digests of its parts."""
    rows, giants = _split(docs, model_path, chunk_chars)
    encode, decode = _encoded(model_path), _decoded(model_path)
    out = rows.mapInArrow(lambda batches: _digested(decode(encode(batches))), _PART).drop("row", "part")
    if giants is None:
        return out
    trace = _traced(model_path)
    parts = giants.mapInArrow(lambda batches: _digested(decode(trace(batches))), _PART).select("row", "part", "doc_id", "n_chars", "n_pieces", "ids_crc32", "round_trip")
    ordered = parts.repartition(shuffle_partitions(docs.sparkSession), "row").sortWithinPartitions("row", "part")
    return out.unionByName(ordered.mapInArrow(_whole_digests, _DIGEST))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
