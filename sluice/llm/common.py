"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import struct
import tempfile
import uuid
import zlib
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters that neither composition nor lower-casing turns into several, and marks that no special token or contraction has.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"
_MARK_SIGNS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
_MARKS = f"[{re.escape(_MARK_SIGNS)}]*"
_WORD = re.compile(_LETTERS)
_PLAIN_WORD = re.compile(f"({_LETTERS})({_MARKS})")
_PLAIN_LINES = re.compile(f"({_LETTERS})({_MARKS})(?:\n({_LETTERS})({_MARKS}))?")
_OTHER_SPACES = [c for c in map(chr, range(0x110000)) if c.isspace() and c != " "]
#: How byte-level vocabularies write the bytes that letters beyond ASCII have.
_BYTES = {0x80 + i: chr(0x122 + i) for i in range(0x21)} | {0xAD: chr(0x143)}
#: A stop or comma alone between a letter and white space: a word of its own where white space is dropped.
_STOP = re.compile(r"[.,](?<=[A-Za-z][.,])(?=[ \n])")
#: The code point that a byte-level vocabulary writes for each byte; a space, which no word has, stays.
_BYTE_POINTS = np.array([ord(_BYTES.get(b, chr(b))) for b in range(256)], "<u4")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, where both are one process, gets a temporary folder when the
    setting is absent; a cluster without it is an error.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch.get() is not None:
        _scratch.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """What is stored inside is deleted at the end, but for the tables appended to what this gives."""
    paths, kept = [], []
    token = _scratch.set(paths)
    try:
        yield kept
    finally:
        _scratch.reset(token)
        files = [f for df in kept for f in df.inputFiles()]
        for path in paths:
            if not any(path.rpartition("/")[2] in f for f in files):
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            elif _scratch.get() is not None:
                _scratch.get().append(path)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of df, whatever its extra columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id, parts: int):
    """crc32 of the decimal text of an id, modulo parts (a null id falls in fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


_wordy: np.ndarray | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 14, _BASE, np.uint64), dtype=np.uint64)


def _word_table() -> np.ndarray:
    """Which code points are letters, digits or underscores; made once in a worker process."""
    global _wordy
    if _wordy is None:
        _wordy = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
        _wordy[ord("_")] = True
    return _wordy


def _hashed(points: np.ndarray, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places and the hashes of the words among code points."""
    edge = np.flatnonzero(np.diff(wordy, prepend=False, append=False))
    begin, size = edge[0::2], edge[1::2] - edge[0::2]
    if not len(begin):
        return begin, np.empty(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    parts = (points[wordy].astype(np.uint64) + np.uint64(1)) * _POWERS[place & (len(_POWERS) - 1)]
    return begin, mix(np.add.reduceat(parts, first) ^ size.astype(np.uint64))


def word_hashes_of(texts: list[str | None], together: int = 1_000_000) -> list[np.ndarray]:
    """The 64-bit hashes of all words of each text, in order; null counts as empty.

    A word is a run of letters, digits or underscores of the lower-cased text. Texts are
    hashed many at a time and long ones part by part, cut where no word is, so memory
    holds the arrays of about `together` characters (or of the longest word).
    """
    out: list[np.ndarray] = []
    for a, b in in_slices(texts, together):
        lowered = [(t or "").lower() for t in texts[a:b]]
        whole, at, begins, found = "\n".join(lowered), 0, [], []
        while at < len(whole):
            size = together * 2
            while True:
                points = np.frombuffer(whole[at : at + size].encode("utf-32-le", "surrogatepass"), "<u4")
                wordy = _word_table()[points]
                if at + size >= len(whole) or not wordy.all():
                    break
                size *= 2  # a word that is longer than the part
            if at + size < len(whole):  # up to the last place that is in no word
                size = len(wordy) - int(np.argmin(wordy[::-1]))
                points, wordy = points[:size], wordy[:size]
            begin, hashes = _hashed(points, wordy)
            begins.append(begin + at)
            found.append(hashes)
            at += size
        hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
        cuts = np.searchsorted(np.concatenate(begins) if begins else np.empty(0, np.int64), np.cumsum([len(t) + 1 for t in lowered])).tolist()
        out += [hashes[x:y] for x, y in zip([0, *cuts], cuts, strict=False)]
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of all words of one text."""
    return word_hashes_of([text])[0]


def lots(batches, column: int, size: int = 1_000_000):
    """Arrow batches cut so that the texts of a column come to about `size` bytes in each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            held = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, held + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of `size` words; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
        out += words[k : len(words) - size + 1 + k]
    return mix(out)


def _space_by_space(text: str) -> bool:
    """Whether a space has white space or an end of the text beside it."""
    return text[:1] == " " or text[-1:] == " " or "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in _OTHER_SPACES)


class IdEncoder:
    """Token ids of whole texts by a vocabulary file of the tokenizers library.

    Pieces between two spaces that have no white space beside them are encoded once and
    kept: both supported kinds of vocabulary cut texts there in any case, so the ids are
    those of the whole text. Where the vocabulary drops white space and case, ASCII texts are
    lower-cased first and a lone stop or comma after a word is a piece of its own, so fewer
    pieces are met once only. Any other text goes through a slower split that keeps runs
    of white space whole. A new piece of Latin letters is one word to both kinds, the marks
    after it another, a line end a third, so the vocabulary's model is asked for them directly,
    for many words at once where no line end is among them. Other new
    pieces are encoded many at a time, joined by a mark that always is a token of its own. The cache has two generations of up to `most` bytes:
    when the younger one is full it becomes the older, whose pieces return when used.
    Strings of special tokens in a text are those tokens, as the library has it by
    default; with `ordinary` they are text like any other.
    """

    #: Bytes that an entry takes besides its piece and ids, at the least.
    ENTRY = 200

    def __init__(self, path: str, ordinary: bool = False, most: int = 160_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.held = most, 0
        # A vocabulary with word ends drops white space; a byte-level one joins it to the next word.
        self.drops_space = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.mark = " \x01 " if self.drops_space else "\n"
        (self.mark_id,) = self._encode([self.mark])[0].tolist()
        # How a word after a space is written for the model: None where that is not so simple.
        self.model, self.lead = self.tokenizer.model, "" if self.drops_space else "\u0120"
        self.plain = _PLAIN_WORD if self.drops_space else _PLAIN_LINES
        self.marks: dict[str, bytes] = {}
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.words = Tokenizer(self.model)  # the model alone, for words as it has them
        self.words.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word, or else that begin one
        self.edge[[i for t, i in vocabulary.items() if (t.endswith(self.model.end_of_word_suffix) if self.drops_space else t.startswith(self.lead))]] = True
        self.folds = len({x.tobytes() for x in self._encode(["ABC Then xQz", "abc then xqz"])}) == 1
        samples = ["the", "Then", "ABC", "xqzvyk", "of.", "End!", "wh?", "re%%%", "n_(x"[:3], "\u00c9t\u00e9", "\u0141\u017c\u00e0\u00ed\u0160\u0117;"]
        samples += [] if self.drops_space else ["end.\nNow", "a\nb!!", "\u00e0.\n\u00c0\u00e9"]
        if [self._word(p) for p in samples] != [x.tobytes() for x in self._encode([self._text(p) for p in samples])]:
            self.lead = None
        self.cache: dict[str | tuple, bytes] = {}
        self.older: dict[str | tuple, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list:
        if self.drops_space:
            if self.folds and text.isascii():
                lowered = text.lower()  # as the vocabulary does, but it looks for special tokens before
                if not any(x in lowered for x in self.special):
                    text = lowered
            return _STOP.sub(r" \g<0>", text).replace("\n", " ").split(" ")
        pieces = _LONE_SPACE.split(text) if _space_by_space(text) else text.split(" ")
        pieces[0] = (pieces[0],)  # the first has no space before it, all others have
        return pieces

    def _text(self, piece: str | tuple) -> str:
        return piece[0] if isinstance(piece, tuple) else piece if self.drops_space else " " + piece

    def _word(self, piece: str) -> bytes | None:
        """The ids of a piece of Latin letters, with marks after them or without, also twice with a line end between; None for any other."""
        found = self.plain.fullmatch(piece)
        if not found:
            return None
        word, mark, *line = found.groups()
        ids = self._tokens(self.lead, word)
        if mark:
            ids += self._mark(mark)
        if line and line[0]:
            ids += self._mark("\u010a") + self._tokens("", line[0])
            if line[1]:
                ids += self._mark(line[1])
        return ids

    def _tokens(self, lead: str, word: str) -> bytes:
        if self.drops_space:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        ids = [t.id for t in self.model.tokenize(lead + word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn_words(self, pieces: list[str], together: int = 500) -> list[str]:
        """Keeps the ids of the pieces that are plain words, which the vocabulary marks at their ends or after a space; gives the others back."""
        plain, words, others = [], [], []
        for p in pieces:  # no matches or tuples are kept, which the garbage collector would walk through
            word = p.rstrip(_MARK_SIGNS) if isinstance(p, str) else ""
            if word.isalpha() and (word.isascii() or _WORD.fullmatch(word)):
                plain.append(p)
                words.append(word)
            else:
                others.append(p)
        lowered = "\n".join(words).lower().split("\n") if self.drops_space else words  # none of these letters becomes two
        if not plain:
            return others
        distinct = set(lowered)
        unknown = distinct.difference(self.cache).difference(self.older)
        ids = {w: self.cache.get(w) or self.older[w] for w in distinct - unknown}
        new = sorted(unknown)  # words of like letters use the same merges
        runs = [new[i : i + together] for i in range(0, len(new), together)]
        points = [_BYTE_POINTS[np.frombuffer(" ".join(run).encode(), np.uint8)] for run in runs]
        got = self.words.encode_batch_fast([self.lead + x.tobytes().decode("utf-32-le").replace(" ", " " + self.lead) for x in points], add_special_tokens=False)
        for run, tokens in zip(runs, got, strict=True):
            flat = np.array(tokens.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.edge[flat] if self.drops_space else np.append(self.edge[flat[1:]], True)) + 1)).tolist()
            if len(ends) != len(run) or ends[-1] != 4 * len(flat):
                ids.update((w, self._tokens(self.lead, w)) for w in run)
                continue
            flat = flat.tobytes()
            ids.update((w, flat[a:b]) for w, a, b in zip(run, [0, *ends], ends, strict=False))
        found = [ids[w] if len(p) == len(w) else ids[w] + self._mark(p[len(w) :]) for p, w in zip(plain, lowered, strict=True)]
        self.cache.update(zip(plain, found, strict=True))
        self.held += self.ENTRY * len(plain) + sum(map(len, plain)) + sum(map(len, found))
        return others

    def _mark(self, mark: str) -> bytes:
        ids = self.marks.get(mark)
        if ids is None:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            found = [t.id for t in self.model.tokenize(mark)]
            ids = self.marks[mark] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _learn(self, pieces: list, together: int = 200) -> None:
        mark = self.mark.strip(" ")
        plain, odd = [], []
        by_word = not self.drops_space and self.lead is not None
        if self.lead is not None:
            pieces = self._learn_words(pieces)
        for piece in pieces:
            ids = self._word(piece) if by_word and isinstance(piece, str) else None
            if ids is not None:
                self._keep(piece, ids)
                continue
            p = self._text(piece)
            alone = mark in p or not p or p[-1].isspace() or p[:1].isspace() and p[:1] != " " or any(x in p for x in self.special)
            (odd if alone else plain).append(piece)
        runs = [plain[i : i + together] for i in range(0, len(plain), together)]
        for run, ids in zip(runs, self._encode([self.mark.join(map(self._text, r)) for r in runs]), strict=True):
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(run) - 1:
                odd += run
                continue
            flat, at = ids.tobytes(), 0
            for piece, cut in zip(run, [*cuts.tolist(), len(ids)], strict=True):
                self._keep(piece, flat[4 * at : 4 * cut])
                at = cut + 1
        for start in range(0, len(odd), 1000):
            for piece, ids in zip(odd[start : start + 1000], self._encode([self._text(p) for p in odd[start : start + 1000]]), strict=True):
                self._keep(piece, ids.tobytes())

    def _keep(self, piece: str | tuple, ids: bytes) -> None:
        self.cache[piece] = ids
        self.held += self.ENTRY + len(self._text(piece)) + len(ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; null counts as empty."""
        split = [self.split(t) if t else [] for t in texts]
        used = set().union(*split)
        missing = list(used.difference(self.cache))
        if missing:
            if self.held > self.most:  # what a call adds is bounded by the length of its texts
                self.older, self.cache, self.held = self.cache, {}, 0
                missing = list(used)
            if self.older:
                back = {p: self.older[p] for p in missing if p in self.older}
                self.cache |= back
                self.held += sum(self.ENTRY + len(p if isinstance(p, str) else p[0]) for p in back) + sum(map(len, back.values()))
                missing = [p for p in missing if p not in back]
            self._learn(missing)
        cache = self.cache
        take = {p: cache[p] for p in used}.__getitem__  # smaller, so that its places are nearer
        return [np.frombuffer(b"".join(map(take, pieces)), dtype="<u4") for pieces in split]


_encoders: dict[tuple, IdEncoder] = {}


def encoder(path: str, ordinary: bool = False, cache: int = 160_000_000) -> IdEncoder:
    """The worker process's encoder, whose cache serves later tasks; one with other settings takes its place."""
    settings = (path, ordinary, cache)
    if settings not in _encoders:
        _encoders.clear()
        _encoders[settings] = IdEncoder(*settings)
    return _encoders[settings]


def forget() -> None:
    """Gives the memory of the encoder's cache back: worker processes outlive the step that filled it."""
    _encoders.clear()
    trim()


def trim() -> None:
    """Gives memory that is free but still held back to the system: worker processes outlive their steps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy(run):
    """A step of a chain over Arrow batches: without what earlier steps' encoders hold in this process, and giving free memory back at its end."""

    def tidied(batches):
        forget()
        yield from run(batches)
        trim()

    return tidied


def in_slices(texts: list, chars: int = 2_000_000):
    """(start, end) of slices that hold about `chars` characters each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
