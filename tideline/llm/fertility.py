"""Quality rules from tokeniser fertility.

Two public vocabularies encode each distinct word once: one of pieces with byte fallback, made
for a few languages, and one of bytes made for many. Under each, a text is judged on characters
per token, on the share of tokens that are no whole characters (byte fallback, or fragments of
a character), and on the entropy of its tokens. It is rejected where one of them leaves the band
of its language or, without one, of its script.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import utf8

VOCABULARIES = ("/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SYMBOLS = "#*$%&|<>"
#: Per vocabulary: least characters per token, greatest share of tokens that are no whole
#: characters, least entropy in bits. The languages' limits are the least (greatest) value of the
#: documents of 50 words or more that labels call good, sf0.1, with about 8 % (entropy: 0.25 bits)
#: of room: least characters per token en 1.85 and 1.99, de 2.05 and 2.16, fr 1.65 and 1.81, es 1.80
#: and 1.92; least entropy 5.56 and 5.55, 5.77 and 5.83, 5.55 and 5.65, 5.77 and 5.72; greatest byte
#: share 0 and 0.033. The scripts' limits are a third to a half of what article 1 of the Universal
#: Declaration of Human Rights measures (twice, for shares): short, plain text of each.
BANDS: dict[str, tuple[tuple[float, float, float], tuple[float, float, float]]] = {
    "en": ((1.70, 0.05, 5.3), (1.82, 0.06, 5.3)),
    "de": ((1.88, 0.05, 5.5), (1.98, 0.08, 5.5)),
    "fr": ((1.52, 0.05, 5.3), (1.66, 0.08, 5.4)),
    "es": ((1.65, 0.05, 5.5), (1.76, 0.08, 5.4)),
    "latin": ((1.40, 0.25, 4.0), (1.40, 0.25, 4.0)),
    "cyrillic": ((0.90, 0.10, 4.0), (1.10, 0.25, 4.0)),
    "greek": ((0.40, 0.10, 3.0), (0.70, 0.25, 3.5)),
    "hebrew": ((0.40, 0.20, 3.0), (0.60, 0.55, 3.0)),
    "arabic": ((0.40, 0.20, 3.0), (0.60, 0.30, 3.0)),
    "indic": ((0.30, 0.90, 3.0), (0.30, 0.90, 3.0)),
    "thai": ((0.40, 0.30, 3.0), (0.40, 0.60, 3.0)),
    "hangul": ((0.30, 0.60, 3.0), (0.40, 0.90, 3.0)),
    "han": ((0.30, 0.60, 3.0), (0.40, 0.75, 3.0)),
    "other": ((0.20, 1.0, 3.0), (0.20, 1.0, 3.0)),
}
#: First code points of ranges of letters, in order, with their script; "" counts for none.
SCRIPT_STARTS = (
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"),
    (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x3000, ""), (0x3040, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "other"), (0x1F000, ""), (0x20000, "han"), (0x323B0, ""),
)


def _broken(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


def encoder(path: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """How a vocabulary file encodes words, and which of its tokens are no whole characters."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        # Words are encoded one by one, so the pattern only has to take one whole.
        coder = tiktoken.Encoding("vocabulary", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        broken = np.zeros(max(ranks.values()) + 1, bool)
        broken[[k for token, k in ranks.items() if _broken(token)]] = True
        longest = 2000  # longer words go in pieces: merging is slow on very long ones

        def encode(words: list[str]) -> list[list[int]]:
            return [list(chain.from_iterable(coder.encode_ordinary(x[k : k + longest]) for k in range(0, len(x), longest))) for x in (f" {w}" for w in words)]

        return encode, broken
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda words: model.encode(words, num_threads=1), np.array([model.is_byte(k) for k in range(model.get_piece_size())])


class _Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class WordTokens:
    """Tokens of words under several vocabularies, each distinct word encoded once; emptied when it holds too many.

    Words are numbered as they come; under vocabulary v the tokens of word k are
    flat[v][start[v][k] : start[v][k + 1]].
    """

    def __init__(self, paths: tuple[str, ...], most: int = 500_000):
        self.coders = [encoder(p) for p in paths]
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.start = [np.zeros(1, np.int64) for _ in self.coders]
        self.flat = [np.zeros(0, np.int32) for _ in self.coders]

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Word numbers of the words of each text."""
        if len(self.number) > self.most:
            self.clear()
        known = len(self.number)
        out = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in texts]
        missing = [w.decode("utf-8", "replace") for w in islice(reversed(self.number), len(self.number) - known)][::-1]
        for v, (encode, _) in enumerate(self.coders) if missing else ():
            starts, flats = [self.start[v]], [self.flat[v]]
            for k in range(0, len(missing), 20_000):
                ids = encode(missing[k : k + 20_000])
                starts.append(starts[-1][-1] + np.cumsum(list(map(len, ids))))
                flats.append(np.array(list(chain.from_iterable(ids)), np.int32))
            self.start[v], self.flat[v] = np.concatenate(starts), np.concatenate(flats)
        return out


def fertility(codes: np.ndarray, chars: int, held: WordTokens, v: int = 0) -> tuple[int, float, float, float]:
    """Number of tokens, characters per token, share of broken characters, entropy of the tokens in bits."""
    if not len(codes):
        return 0, 0.0, 0.0, 0.0
    ordered = np.sort(codes)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    used, times = ordered[first], np.diff(np.r_[first, len(ordered)])
    start = held.start[v]
    lengths = start[used + 1] - start[used]
    total = int(lengths.sum())
    if not total:
        return 0, 0.0, 0.0, 0.0
    at = np.repeat(start[used] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
    ids, weights = held.flat[v][at], np.repeat(times, lengths)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    counts = np.add.reduceat(weights[order], first)
    n = int(counts.sum())
    byte = float(counts[held.coders[v][1][ids[first]]].sum() / n)
    p = counts / n
    return n, chars / n, byte, max(0.0, float(-(p * np.log2(p)).sum()))


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(codes)
    if n < 4:
        return 0
    if int(codes.max()) >= 1 << 20:
        codes = np.unique(codes, return_inverse=True)[1]
    if int(codes.max()) < 1 << 20:
        window = codes[:-2] << 40 | codes[1:-1] << 20 | codes[2:]
    else:
        m = int(codes.max()) + 1
        window = np.unique(codes[:-1] * m + codes[1:], return_inverse=True)[1][:-1] * m + codes[2:]
    ordered = np.sort(window)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(window, again)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def base_rules(text: bytes) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines of a text in UTF-8."""
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, b" \t\n\v\f\r")))
    symbols = len(text) - len(text.translate(None, SYMBOLS.encode()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return chars, symbols, len(lines) - len(set(lines))


def script_of(text: bytes) -> str:
    """The script of most letters; other where there are none; ties go by name."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = np.searchsorted(np.array([x for x, _ in SCRIPT_STARTS], np.uint32), points, side="right") - 1
    counts: dict[str, int] = {}
    for (_, name), n in zip(SCRIPT_STARTS, np.bincount(at, minlength=len(SCRIPT_STARTS)).tolist()):
        if name and n:
            counts[name] = counts.get(name, 0) + n
    return min(counts, key=lambda k: (-counts[k], k), default="other")


def passes(bands: dict, lang: str | None, text: bytes, found: list[tuple[int, float, float, float]]) -> bool:
    """Whether all vocabularies' measures are in the band of the language, or of the script where it has none."""
    if not all(f[0] for f in found):
        return False
    limits = bands.get(lang or "") or bands[script_of(text)]
    return all(per >= least and share <= most and entropy >= low for (_, per, share, entropy), (least, most, low) in zip(found, limits))


OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, n_tokens_bytes long, chars_per_token_bytes double, fragment_share double, token_entropy_bytes double"
)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabularies: tuple[str, str] = VOCABULARIES, bands: dict | None = None, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """One row per input row with base counts, fertility under both vocabularies, and the verdict.

    Words are runs other than space and U+0009-000D. A null or empty text has no words and
    fails. An unknown or null language is judged by its script's band. Works on whole texts, a
    batch of rows at a time. An empty table gives no rows.
    """
    bands = bands or BANDS
    fields = [f.split() for f in OUT.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k] for _, k in fields]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordTokens(vocabularies)
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            texts = [x or b"" for x in utf8(b.column(1))]
            split = [x.split() for x in texts]
            rows = []
            for i, lang, text, codes in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts, held.numbers(split)):
                chars, symbols, lines = base_rules(text)
                repeats = repeated_words(codes)
                found = [fertility(codes, chars, held, v) for v in range(len(vocabularies))]
                failed = len(codes) < min_words or 100 * repeats > most_repeated * len(codes)
                rows.append((i, len(codes), chars, symbols, lines, repeats, failed, not failed and passes(bands, lang, text, found), *chain.from_iterable(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[n for n, _ in fields])

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), lang).mapInArrow(judge, OUT)
