"""Quality rules: plain counts of words, symbols and repeats, and how a public tokenizer fares on the text."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.bpe import load_ranks
from tidemark.llm.common import chunks, col, fresh, only

#: Counted as symbols.
SYMBOLS = "#*$%&|<>"


#: Tokens of a text are looked at in blocks of so many, so that what is said of them doesn't follow the text's length.
BLOCK = 128


@dataclass(frozen=True)
class Band:
    """What clean texts of a language or script stay within. A text outside is rejected.

    chars_per_token: lowest and highest mean of characters of words per token; fallback: highest share of tokens that are
    single bytes of a character beyond ASCII; entropy: lowest mean entropy of a block's tokens, as a share of the most that
    so many tokens can have. These hold for every vocabulary. best: the lowest entropy by the vocabulary with the most characters per
    token, which knows the script best. Words with symbols or separators after each have few different tokens among many.
    """

    chars_per_token: tuple[float, float]
    fallback: float
    entropy: float
    best: float


#: Bands by language where a row names one that is here, else by script. Bounds are round numbers, wide of what the two public
#: vocabularies give clean prose in 35 languages (tests/llm/test_quality.py). Scripts that a vocabulary holds letter by letter, or
#: byte by byte, have few characters a token and many bytes; `other` are scripts that none may hold at all, so bytes alone reject no text there.
#: `marked` is Latin script with many letters beyond those of European languages, as in Vietnamese, Yoruba, Igbo or Ewe.
BANDS = {
    "latin": Band((1.35, 9.0), 0.10, 0.75, 0.75),
    "marked": Band((0.85, 9.0), 0.40, 0.65, 0.70),
    "cyrillic": Band((1.0, 9.0), 0.35, 0.70, 0.77),
    "greek": Band((0.7, 9.0), 0.20, 0.55, 0.78),
    "arabic": Band((0.7, 9.0), 0.30, 0.52, 0.74),
    "hebrew": Band((0.7, 9.0), 0.30, 0.48, 0.77),
    "devanagari": Band((0.6, 9.0), 0.50, 0.54, 0.58),
    "thai": Band((0.7, 9.0), 0.30, 0.58, 0.62),
    "hangul": Band((0.5, 4.0), 0.40, 0.62, 0.80),
    "cjk": Band((0.4, 4.0), 0.50, 0.56, 0.66),
    "other": Band((0.25, 9.0), 1.0, 0.40, 0.50),
}

#: First and last code points of the scripts with bands; `extra` are the letters that make Latin script `marked`.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x17F)),
    "extra": ((0x180, 0x2AF), (0x300, 0x36F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "cjk": ((0x2E80, 0x2FDF), (0x3040, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
}
#: Share of the letters of a Latin text, from which it is `marked`.
MARKED = 0.10

_SCRIPTS = list(RANGES)
_BOUNDS = sorted((first, last, k) for k, name in enumerate(_SCRIPTS) for first, last in RANGES[name])
_FIRST, _LAST, _KIND = (np.array(x) for x in zip(*_BOUNDS, strict=True))


def script_of(text: str) -> str:
    """The script of most letters; `latin` for ASCII texts and for texts without letters."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.searchsorted(_FIRST, points, side="right") - 1
    inside = (at >= 0) & (points <= _LAST[at])
    counts = dict(zip(_SCRIPTS, np.bincount(_KIND[at[inside]], minlength=len(_SCRIPTS)).tolist(), strict=True))
    extra = counts.pop("extra")
    counts["latin"] += extra
    most = max(counts.values())
    if len(text) - sum(counts.values()) > most:
        counts["other"] = sum(map(str.isalpha, text)) - sum(counts.values())
    name = max(counts, key=counts.get)  # the first of equals
    return "latin" if counts[name] <= 0 else "marked" if name == "latin" and extra >= MARKED * counts["latin"] else name


def within(band: Band, told: Sequence[tuple[float, float, float]]) -> bool:
    """Whether what each vocabulary says of a text (characters per token, byte share, entropy) is within the band."""
    low, high = band.chars_per_token
    return all(low <= per <= high and share <= band.fallback and entropy >= band.entropy for per, share, entropy in told) and max(told)[2] >= band.best


#: White space to Python that the word rule doesn't count as such.
OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """Runs of characters other than the six ASCII blanks."""
    return [w.decode() for w in text.encode().split()] if OTHER_BLANKS.search(text) else text.split()


def repeated_words(ids: np.ndarray) -> int:
    """How many words stand in a window of three words that the text has twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    base = int(ids.max()) + 1
    windows = ids[:-2] * base + ids[1:-1]
    if base > 2_000_000:  # three ids no longer fit in 63 bits
        _, windows = np.unique(windows, return_inverse=True)
        base = max(base, int(windows.max()) + 1)
    windows = windows * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines that have a word and equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.encode().split()]
    return len(lines) - len(set(lines))


class Vocabulary:
    """Tokens of words by one public vocabulary: a sentencepiece model, or a rank file of byte-level BPE."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda words: _listed(model.encode(words, num_threads=1))
            self.fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        else:
            import public_tokenizers
            import tiktoken

            ranks = load_ranks(path)
            model = tiktoken.Encoding("quality", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            long = np.zeros(max(ranks.values()) + 1, np.int64)
            long[list(ranks.values())] = [len(token) for token in ranks]
            self.encode = functools.partial(_cut_by_bytes, model, long)
            self.fallback = np.zeros(len(long), bool)
            self.fallback[[rank for token, rank in ranks.items() if len(token) == 1 and token[0] > 127]] = True


def _listed(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each word has, and all tokens in order."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))


def _cut_by_bytes(model, long: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As _listed(), of words with a blank before each. No token goes from one word into the next, so all are encoded as one text, and cut where the tokens' bytes reach each word's end."""
    ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
    ids = model.encode_to_numpy(" " + " ".join(words), disallowed_special=())
    reached = np.cumsum(long[ids])
    stops = np.searchsorted(reached, ends) + 1
    if len(ids) == 0 or stops[-1] != len(ids) or (reached[stops - 1] != ends).any():
        return _listed([model.encode_ordinary(f" {w}") for w in words])
    return np.diff(stops, prepend=0), ids.astype(np.uint32)


#: Words that a worker holds with their tokens, some 200 bytes each, before it forgets them all.
HELD = 600_000

#: Characters of text that are judged and handed on at once, a text more at most.
CHUNK = 1 << 20


class Lexicon:
    """Numbers words as they come, and holds their tokens by each vocabulary side by side, until there are too many."""

    def __init__(self, vocabularies: Sequence[str], most: int = HELD):
        self.most = most
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        self.public = [Vocabulary(path) for path in vocabularies]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes, self.flat = ([np.zeros(0, kind) for _ in self.public] for kind in (np.int64, np.uint32))
        self.begins = list(self.sizes)

    def learn(self, words: list[str]) -> None:
        if len(self.number) > self.most:
            self.forget()
        new = [w for w in words if w not in self.number]
        if not new:
            return
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        for k, v in enumerate(self.public):
            sizes, ids = v.encode(new)
            self.sizes[k] = np.concatenate([self.sizes[k], sizes])
            self.flat[k] = np.concatenate([self.flat[k], ids])
            self.begins[k] = np.cumsum(self.sizes[k]) - self.sizes[k]

    def fertility(self, words: np.ndarray, chars: int) -> list[tuple[float, float, float]]:
        """By each vocabulary: characters per token, share of byte tokens, mean entropy of blocks of tokens as a share of its highest value."""
        out = []
        for v, sizes, flat, begins in zip(self.public, self.sizes, self.flat, self.begins, strict=True):
            n = sizes[words]
            ends = np.cumsum(n)
            ids = flat[np.repeat(begins[words] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
            out.append((chars / len(ids), float(v.fallback[ids].mean()), block_entropy(ids)) if len(ids) else (0.0, 0.0, 0.0))
        return out


def block_entropy(ids: np.ndarray, block: int = BLOCK) -> float:
    """The mean, over blocks of `block` ids (the last takes what is left over; a shorter text is one), of the entropy of a
    block's ids over the log of their number; 0 for a single id."""
    n = len(ids)
    if n < 2:
        return 0.0
    blocks = max(1, n // block)
    of = np.minimum(np.arange(n) // block, blocks - 1)
    keys = np.sort(of << 32 | ids)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(starts, n))
    size = np.bincount(of)
    spread = np.bincount(keys[starts] >> 32, counts * np.log2(counts))
    return float(np.mean((np.log2(size) - spread / size) / np.log2(np.maximum(size, 2))))


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_per_token array<double>, fallback_share array<double>, token_entropy array<double>, script string, kept boolean"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "string": pa.string()}


def quality(docs: DataFrame, vocabularies: Sequence[str], *, bands: dict[str, Band] | None = None, min_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pass_through: tuple[str, ...] = (), held: int = HELD) -> DataFrame:
    """One row per input row: its id, word and symbol counts, what each vocabulary's tokens say, base_failed and kept.

    vocabularies: paths, that executors can open, of sentencepiece models (.model) or byte-level rank files. base_failed:
    under `min_words` words, or over `most_repeated` per cent of the words in repeated 3-word windows. kept: not
    base_failed, and by every vocabulary within the band of the row's language (if docs has `lang_col` and there is a band
    for it), else of the text's script. Null text counts as empty and so fails; a null id stays null; repeated rows each get
    their row; an empty table gives none. `pass_through` names columns to return as they are in front; where their names
    clash with those of the measures, the measures get underscores.
    Texts are read whole, a bounded number of characters at a time and a text more at most, so memory follows the longest text, not the partition.
    `held` sets what a Python worker needs, for time: words that it holds with their tokens.
    """
    bands = BANDS if bands is None else bands
    lang = col(lang_col).cast("string") if lang_col.lower() in {c.lower() for c in docs.columns} else F.lit(None).cast("string")
    kept = docs.select(*map(col, pass_through))
    names = fresh(kept, *(c.split()[0] for c in COLUMNS.split(", ")))
    kinds = [_TYPES[c.split()[1]] for c in COLUMNS.split(", ")]
    carried = list(kept.schema.fields)
    out_schema = StructType([*carried, *(StructField(name, t.dataType) for name, t in zip(names, StructType.fromDDL(COLUMNS).fields, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = only(Lexicon, tuple(vocabularies), held)
        for batch in batches:
            given = ((i, t, of) for start in range(0, batch.num_rows, 100) for few in [batch.slice(start, 100)] for i, t, of in zip(*(few.column(k).to_pylist() for k in at), strict=True))
            done = 0
            for part in chunks(given, lambda r: len(r[1] or ""), CHUNK):
                rows: list[tuple] = []
                split = [(i, t or "", words_of(t or ""), of) for i, t, of in part]
                coded = pa.array(list(chain.from_iterable(w for _, _, w, _ in split)), pa.string()).dictionary_encode()  # each distinct word is looked up once
                distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
                known.learn(distinct)
                placed = np.fromiter(map(known.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
                sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
                stop = 0
                for doc_id, text, words, of in split:
                    start, stop = stop, stop + len(words)
                    n, chars, numbers = len(words), int(sizes[start:stop].sum()), placed[start:stop]
                    repeats = repeated_words(numbers)
                    failed = n < min_words or 100 * repeats > most_repeated * n
                    script = script_of(text)
                    band = bands.get(of) or bands[script]
                    told = known.fertility(numbers, chars)
                    rows.append((doc_id, n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, *([t[i] for t in told] for i in range(3)), script, not failed and within(band, told)))
                own = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(done, len(part)).columns[: len(carried)], *own], names=[*(f.name for f in carried), *names])
                done += len(part)

    read, at = list(map(col, pass_through)), []  # at: where the id, the text and the language stand; what is passed through isn't sent again
    for name, kind, column in ((id_col, "bigint", col(id_col).cast("long")), (text_col, "string", col(text_col).cast("string")), (lang_col, "string", lang)):
        if (name, kind) in kept.dtypes:
            at.append(kept.dtypes.index((name, kind)))
        else:
            at.append(len(read))
            read.append(column)
    return docs.select(*(c.alias(f"c{i}") for i, c in enumerate(read))).mapInArrow(run, out_schema)
