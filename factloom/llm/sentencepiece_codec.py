"""SentencePiece encoding by a streaming Viterbi pass, and decoding, without the library's own encoder."""

from __future__ import annotations

import re
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public tokenizer model that the queries use.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose ids a task keeps, in each of two generations; longer segments are never kept.
KEPT, KEPT_LENGTH = 250_000, 48
#: Moves that are kept beside those of the trie (others are found by its fallbacks each time), and pairs of pieces for
#: which a task keeps whether one may follow the other, before it begins anew.
MOVES, PAIRS = 200_000, 600_000
#: Rows of a result that are in memory at once.
ROWS = 256
NEVER = float("-inf")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class _Kept(dict):
    """Segment to ids. Two generations are kept, so that frequent segments survive when there are too many."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, segment: str) -> tuple[int, ...]:
        found = self.older.get(segment)
        if found is None:
            found = self.make(segment)
        if len(segment) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[segment] = found
        return found


class Codec:
    """Encoder and decoder of one model.

    encode_stream is the one encoder. It reads characters one by one. For each end it keeps one backpointer: the
    last piece, whose length tells where it starts. An Aho-Corasick automaton over the pieces tells in one move a
    character which pieces end there and which starts have an unfinished piece. Only these starts, all within the
    longest piece, and the end itself can still be used, so these are the surviving paths; whenever all of them pass
    through one boundary, the ids before it are committed. The results of segments, between which no piece can lie,
    so that paths always converge there, are kept and used again.

    In a unigram model the backpointer is that of the best sum of scores. In a BPE model it is the one piece
    that ends the BPE merge of the prefix: pieces follow each other in a merge result if and only if merging
    the two alone leaves them as they are, so a piece fits if it does so after the piece that ends at its start.
    """

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("only unigram and BPE models with identity normalisation and without user-defined or unused pieces")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.bytes_ = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        self.multibyte = {i for b, i in self.bytes_.items() if b > 127}
        self.shown = ["" if p.type == CONTROL else chr(int(p.piece[3:-1], 16)) if p.type == BYTE else p.piece.replace(SPACE, " ") for p in proto.pieces]
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        many = [p for p in self.ids if len(p) > 1]
        self.score_of = {p: self.scores[i] for p, i in self.ids.items()}
        self.fits: dict[str, dict[str | None, bool]] = {p: {} for p in self.ids}  # piece, piece before it or None
        self.merges: dict[str, list | None] = {}
        self.pairs, self.room = 0, MOVES
        self.root = self._automaton()
        self.commits = self.window = 0  # commits so far, and the most characters that waited for one
        self.seen, self.words, self.bare = _Kept(self._segment), _Kept(self._word), _Kept(self._bare)
        joined = {c for p in many for c in p} - {SPACE}
        inner = any(SPACE in p.lstrip(SPACE) for p in many)
        of = "".join(map(re.escape, sorted(joined))) or "\\0"
        # between these segments no piece can lie
        self.segments = re.compile(f"(?s)[{of}{SPACE}]+|." if inner else f"(?s){SPACE}*[{of}]+|{SPACE}+|.").findall
        letters = "".join(re.escape(c) for c in sorted(joined) if c.isalpha()) or "\\0"
        self.plain = re.compile(f"[{letters}]+").fullmatch  # one segment also with a space before it, and nothing to cut
        # words can be encoded apart, each with the space before it, and so can lines
        self.apart, self.newline = self.prefix and not inner and "\n" not in joined, self._ids_of("\n")
        after = {b for p in many for a, b in zip(p, p[1:], strict=False) if a.isalpha() and not b.isalpha()}
        cuts = "".join(re.escape(c) for c in sorted(joined) if not c.isalpha() and c not in after)
        self.finer = re.compile(f"(?s)(?<=[^\\W\\d_])(?=[{cuts}])").split if cuts and not inner else None

    def _automaton(self) -> tuple:
        """The root of the automaton. A state is the longest end of the text with which a piece begins: its moves, the
        pieces that end there (the longest first) with their lengths and fits, how far back the unfinished pieces
        start, and the state of the next shorter end."""
        root: tuple = ({}, [], [], [])
        for p in self.ids:
            node = root
            for c in p:
                node = node[0].setdefault(c, ({}, [], [], []))
            node[1].append((len(p), p, self.fits[p]))
        level, depth = [(c, node, root) for c, node in root[0].items()], 1
        while level:
            after = []
            for c, node, shorter in level:  # shorter: where the search for the next shorter end begins
                while shorter is not root and c not in shorter[0]:
                    shorter = shorter[3][0]
                shorter = shorter[0].get(c, root) if depth > 1 else root
                moves, ends, starts, fallback = node
                fallback.append(shorter)
                ends += shorter[1]
                if moves:
                    starts.append(depth)
                starts += shorter[2]
                after += [(x, child, shorter) for x, child in moves.items()]
            level, depth = after, depth + 1
        return root

    def _move(self, state: tuple, c: str) -> tuple:
        """The state after c, where the trie has no move for it; kept while there is room."""
        root, at, found = self.root, state, None
        while found is None and at is not root:
            at = at[3][0]
            found = at[0].get(c)
        if found is None:
            return root
        if self.room:
            self.room -= 1
            state[0][c] = found
        return found

    def merge(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """BPE of a short text: the adjacent pair of highest score is merged first, the left one of equals. Gives the
        parts that are left, and for each merge its score with the first and last part after it."""
        parts, steps = list(text), []
        score = self.score_of.get
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def _steps(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges of a piece by itself, ended by one that never comes; None if they don't give the piece."""
        if piece not in self.merges:
            if len(self.merges) > len(self.ids) + 50_000:  # characters without a piece are unlimited
                self.merges.clear()
            parts, steps = self.merge(piece)
            self.merges[piece] = [*steps, (NEVER, "", "")] if parts == [piece] else None
        return self.merges[piece]

    def _apart(self, before: str, piece: str) -> bool:
        """Whether merging both together leaves the two. Until a merge joins them, each goes through its own merges;
        which of these or of the pair at the border is next, is told by the score, and by the place of equals."""
        left, right = self._steps(before), self._steps(piece)
        if left is None or right is None:
            return False
        score, i, j, end, start = self.score_of.get, 0, 0, before[-1], piece[0]
        border = score(end + start, NEVER)
        while True:
            a, b = left[i], right[j]
            if border > a[0] and border >= b[0]:
                return False
            if a[0] >= b[0]:
                if a[0] == NEVER:
                    return True
                i += 1
                if a[2] != end:
                    end = a[2]
                    border = score(end + start, NEVER)
            else:
                j += 1
                if b[1] != start:
                    start = b[1]
                    border = score(end + start, NEVER)

    def follows(self, before: str | None, piece: str) -> bool:
        """Whether merging leaves piece as it is after the piece before it, or at the beginning of the text (None)."""
        ok = self.fits[piece].get(before)
        if ok is None:
            if self.pairs >= PAIRS:
                for known in self.fits.values():
                    known.clear()
                self.pairs = 0
            self.pairs += 1
            ok = self.fits[piece][before] = self._steps(piece) is not None if before is None else self._apart(before, piece)
        return ok

    def encode_stream(self, chars):
        """Pieces of an iterable of characters (spaces already replaced), yielded as soon as they are certain."""
        return chain.from_iterable(self._windows(chars))

    def _windows(self, chars):
        """The pieces of each commit."""
        last, score = [None], [0.0]  # at each end from the committed boundary: the piece that ends there, the score
        state, longest, unigram = self.root, self.longest, self.kind == UNIGRAM
        end = 0
        for c in chars:
            state = state[0].get(c) or self._move(state, c)
            end += 1
            if unigram:
                best = None
                least = top = score[end - 1] + self.floor  # of the character alone
                for n, piece, _ in state[1]:
                    s = score[end - n] + self.score_of[piece]
                    if best is None or s > top:
                        best, top = piece, s
                if best is None or (c not in self.ids and least > top):
                    best, top = c, least
                score.append(top)
            else:
                for n, piece, fits in state[1]:
                    before = last[end - n]
                    ok = fits.get(before)
                    if self.follows(before, piece) if ok is None else ok:  # one fits
                        best = piece
                        break
                else:
                    best = c
            last.append(best)
            open_ = state[2]
            if not open_:
                boundary = end
            elif end % longest:
                continue
            else:
                boundary = self._converged({end, *(end - n for n in open_)}, last)
            if boundary:
                yield self._committed(boundary, last)
                end -= boundary
                last = last[boundary:]
                if unigram:
                    score = [0.0, *(x - score[boundary] for x in score[boundary + 1 :])]
        if end:
            yield self._committed(end, last)

    @staticmethod
    def _converged(alive: set[int], last: list) -> int:
        """The boundary where the paths to all of the ends have met, followed back from the furthest."""
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(top - len(last[top]))
        return alive.pop()

    def _committed(self, boundary: int, last: list) -> list[str]:
        """Pieces of the path to boundary."""
        self.commits += 1
        self.window = max(self.window, len(last) - 1)
        path = []
        while boundary:
            piece = last[boundary]
            path.append(piece)
            boundary -= len(piece)
        return path[::-1]

    def _ids_of(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        return [self.bytes_[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def _streamed(self, segment: str) -> tuple[int, ...]:
        pieces = [p for window in self._windows(segment) for p in window]
        found = tuple(map(self.ids.get, pieces))
        return tuple(chain.from_iterable(map(self._ids_of, pieces))) if None in found else found

    def _segment(self, segment: str) -> tuple[int, ...]:
        parts = self.finer(segment) if self.finer else [segment]
        if len(parts) > 1:
            return tuple(chain.from_iterable(map(self.seen.__getitem__, parts)))
        return self._streamed(segment)

    def _bare(self, text: str) -> tuple[int, ...]:
        """Ids of text that follows a boundary, without a space before it."""
        return tuple(chain.from_iterable(map(self.seen.__getitem__, self.segments(text))))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word with the space before it; what no piece can join to its first letters is kept apart."""
        if self.plain(word):
            return self._streamed(SPACE + word)
        parts = self.finer(word) if self.finer else [word]
        if len(parts) > 1:
            return self.words[parts[0]] + tuple(chain.from_iterable(map(self.bare.__getitem__, parts[1:])))
        segments = self.segments(SPACE + word)
        return self._streamed(segments[0]) if len(segments) == 1 else tuple(chain.from_iterable(map(self.seen.__getitem__, segments)))

    def _by_words(self, text: str) -> list[int] | None:
        """Ids by lines and words; None where spaces run together."""
        out: list[int] = []
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if n:
                out += self.newline
                first = words[0]
                if first:
                    out += self.bare[first]
                del words[0]
            if "" in words:
                return None
            out += chain.from_iterable(map(self.words.__getitem__, words))
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out = self._by_words(text) if self.apart and SPACE not in text else None
        if out is None:
            text = text.replace(" ", SPACE)
            out = list(chain.from_iterable(map(self.seen.__getitem__, self.segments(SPACE + text if self.prefix else text))))
        if not self.bytes_ and self.unknown in out:  # neighbours of unknown characters are one unknown piece
            out = [x for i, x in enumerate(out) if x != self.unknown or not i or out[i - 1] != x]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; byte pieces are joined and read as UTF-8, control pieces are silent."""
        if self.multibyte.isdisjoint(ids):  # a byte below 128 is a character by itself
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(self.shown[i])
            parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        return text[1:] if self.prefix and text[:1] == " " else text


_CODECS: dict[int, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """The worker's codec of a model; one is kept for each model."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and round_trip for every row of docs.

    ids are the model's ids of the whole text; round_trip tells that decoding them gives the text again, with the
    model's space character read as a space. A null or empty text has no ids. Rows are independent: null and
    repeated doc_ids stay as they are. The model (about 0.5 MB, read on the driver) goes to each task.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_of(model.value)
        for batch in (whole.slice(n, ROWS) for whole in batches for n in range(0, whole.num_rows, ROWS)):
            ids, ends, same = array("i"), [0], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                own = codec.encode(text)
                same.append(codec.decode(own) == text.replace(SPACE, " "))
                ids.extend(own)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for every row of ids; null ids give an empty text."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_of(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
