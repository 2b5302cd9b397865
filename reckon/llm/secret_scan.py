"""Secret scans: fixed credential patterns, and strings that a primed compressor finds novel.

Beside three exact patterns, a string that follows a sensitive word is a candidate. Its novelty is the
number of bytes that zstandard needs for it beyond its surroundings, primed by a dictionary of code
identifiers and of the names and words that many texts share. A string that costs nearly its own length could
not be pieced together from what is known, and is reported, also inside a fixed pattern. Copies of a candidate are taken out of its surroundings, so that a repeated secret does not hide
itself. A map over whole texts; only the count of words for the dictionary shuffles, one row a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.durable import drop_stash, stash
from reckon.llm.common import SLICE_BYTES, cuts, find_words, hash_words, map_texts, utf8

#: Fixed kinds, in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True

SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|bearer|authorization|auth[_-]?key|signature", re.IGNORECASE | re.ASCII)
_SENSITIVE_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth", b"signature")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^*-]{12,}")
_KINDS = re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"), re.compile("[!@#$%^*]")
LEAST_CHARS = 12
#: Characters behind a sensitive word within which a candidate starts.
REACH = 128
AROUND = 256
#: A novel string costs at least this share of its length. A block has a head of three bytes.
NOVEL_SHARE = 0.9
BLOCK, BLOCK_HEAD = 24, 3
LEVEL = 19
#: A candidate has so many characters each of two kinds, or a digit between letters and pieces of one kind that are short.
KIND_CHARS = 3
PIECE_CHARS = 7
_INSIDE, _PIECE = re.compile("[A-Za-z][0-9]+[A-Za-z]"), re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: The dictionary's size, and in how many 64ths of the texts (by hash) a word must occur to stand in it.
DICTIONARY_BYTES = 48 << 10
LEAST_SPREAD = 5

#: Identifiers that code and configuration repeat.
IDENTIFIERS = """
access_token refresh_token client_id client_secret api_key apikey secret_key private_key public_key username password
passwd passphrase credential credentials authorization Authorization Bearer Basic Content-Type application/json
application/x-www-form-urlencoded config configuration settings environment production staging development localhost
127.0.0.1 example.com http:// https:// postgres:// mysql:// mongodb:// redis:// database connection hostname endpoint
import export return function class public private static const let var def self None null true false undefined
getElementById addEventListener createElement querySelector prototype constructor toString hasOwnProperty
request response session cookie header headers params query body payload timeout retries callback promise async await
AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY AWS_REGION GITHUB_TOKEN SLACK_TOKEN DATABASE_URL SECRET_KEY_BASE
2019- 2020- 2021- 2022- 2023- 2024- 2025- 2026- T00:00:00Z 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz qwertyuiop asdfghjkl
    -----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- ssh-rsa ssh-ed25519 sha256 md5 base64 utf-8
"""


def dictionary(words: list[str]) -> bytes:
    """Raw content to prime with: common words, the most frequent last, then the identifiers, within the size."""
    tail = IDENTIFIERS.encode()
    out: list[bytes] = []
    room = DICTIONARY_BYTES - len(tail)
    for w in words:
        piece = w.encode() + b" "
        room -= len(piece)
        if room < 0:
            break
        out.append(piece)
    return b"".join(reversed(out)) + tail


_EDGE = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")


class Novelty:
    """Marginal compressed size under one dictionary."""

    def __init__(self, primed: bytes):
        known = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)

    def cost(self, around: str, string: str) -> int:
        """Bytes of ``string`` behind its surroundings; what stands there or in the dictionary is cheap to copy.

        It is sent in short blocks: a longer one would be coded by the frequency of its letters, and a small
        alphabet would look like knowledge.
        """
        stream = self.packer.compressobj()
        stream.compress(around.encode("utf-8", "replace"))
        stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
        size = 0
        for at in range(0, len(string), BLOCK):
            size += len(stream.compress(string[at : at + BLOCK].encode())) + len(stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)) - BLOCK_HEAD
        return size

    @staticmethod
    def is_mixed(s: str) -> bool:
        """Not a plain word, number or date: kinds of characters are mixed, if only by digits inside a word."""
        if sum(len(kind.findall(s)) >= KIND_CHARS for kind in _KINDS) >= 2:
            return True
        return sum(map(str.isalpha, s)) >= KIND_CHARS and bool(_INSIDE.search(s)) and len(s) <= PIECE_CHARS * len(_PIECE.findall(s))

    def is_novel(self, around: str, string: str) -> bool:
        """Neither the string nor its words in small letters can be pieced together from what is known."""
        words = " ".join(_EDGE.sub(" ", string).lower().split())
        least = NOVEL_SHARE * len(string)
        return self.cost(around, string) >= least and self.cost(around.lower(), words) >= least

    def around(self, text: str, start: int, end: int, parts: list[str]) -> str:
        """The surroundings of a candidate without its own copies, also where their border cuts a copy."""
        reach = AROUND + end - start
        before, after = text[max(0, start - reach) : start], text[end : end + reach]
        for part in parts:
            before, after = before.replace(part, "\0" * len(part)), after.replace(part, "\0" * len(part))
        return (before[-AROUND:] + after[:AROUND]).replace("\0", "")

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Incompressible strings of mixed kinds of characters within reach behind a sensitive word.

        A string that is novel at one of its places is reported at all of those within reach.
        """
        found, novel, done = [], set(), 0
        for word in SENSITIVE.finditer(text):
            for m in CANDIDATE.finditer(text, max(done, word.end()), min(len(text), word.end() + REACH + LEAST_CHARS)):
                whole = CANDIDATE.match(text, m.start())
                s = whole.group()
                done = max(done, whole.end())
                if not self.is_mixed(s):
                    continue
                # the value of a setting is the same secret behind any name
                parts = sorted({s, *(p for p in s.split("=") if len(p) >= LEAST_CHARS)}, key=lambda p: (-len(p), p))
                value = next((p for p in parts if "=" not in p), s)
                found.append((m.start(), whole.end(), value))
                if value not in novel and self.is_novel(self.around(text, m.start(), whole.end(), parts), value):
                    novel.add(value)
        return [(start, end) for start, end, value in found if value in novel]


def _scan(primed: bytes):
    novelty = Novelty(primed)

    def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        body = data.tobytes()
        lower = body.lower()
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        starts, ends, _ = find_words(data, offsets, _HEX)
        long = np.flatnonzero(ends - starts >= 16)
        owner = np.searchsorted(offsets, starts[long], "right") - 1
        hexes: dict[int, list[tuple[int, int]]] = {}
        for o, s, e in zip(owner.tolist(), starts[long].tolist(), ends[long].tolist()):
            hexes.setdefault(o, []).append((s - int(offsets[o]), e - int(offsets[o])))
        for i in range(n):
            a, b = int(offsets[i]), int(offsets[i + 1])
            mine = found[i]
            assign = any(lower.find(w, a, b) >= 0 for w in _ASSIGN_WORDS)
            access = body.find(b"AKIA", a, b) >= 0
            context = any(lower.find(w, a, b) >= 0 for w in _SENSITIVE_WORDS)
            if not (assign or access or context or i in hexes):
                continue
            text = body[a:b].decode("utf-8", "replace")
            if assign:
                mine += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
            if access:
                mine += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
            if i in hexes:
                lead = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
                mine += [(int(lead[s]), 2, int(lead[e])) for s, e in hexes[i]]
            if context:
                mine += [(s, 3, e) for s, e in novelty.spans(text)]
            mine.sort()
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in mine] for mine in found]
        return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return f


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


#: Bytes of the words and names of a dictionary. Next to a digit there is no word: a secret that is repeated in many
#: texts must not prime its own scan.
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = _LETTERS[[45, 95]] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash of the text, text) to (word, spread, n): a bit for each 64th of the texts that holds it, and texts."""
    for batch in batches:
        for lo, hi in cuts(batch.column(1), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            data, offsets = utf8(part.column(1))
            starts, ends, first = find_words(data, offsets, _LETTERS)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            beside = np.concatenate([data, np.zeros(1, np.uint8)])
            after, before = (ends < offsets[doc + 1]) & _DIGITS[beside[ends]], (starts > offsets[doc]) & _DIGITS[beside[starts - 1]]
            fit = (ends - starts >= 3) & (ends - starts <= 32) & ~after & ~before
            starts, ends, doc = starts[fit], ends[fit], doc[fit]
            h = hash_words(data, starts, ends)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
            h, doc, at = h[new], doc[new], order[new]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            bit = np.uint64(1) << (part.column(0).to_numpy().view(np.uint64)[doc] & np.uint64(63))
            spread = np.bitwise_or.reduceat(bit, head) if len(h) else bit
            words = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").lower() for i in at[head]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(spread.view(np.int64)), pa.array(np.diff(np.append(head, len(h))))], names=["word", "spread", "n"])


def fit_dictionary(docs: DataFrame, text_col: str = "text", least_spread: int = LEAST_SPREAD) -> bytes:
    """Prime on the identifiers and on the words of most texts, counted over all whole texts.

    Copies of one text must not count as many: a word's spread is the number of 64ths of the texts, dealt by
    their hashes, that it occurs in. Words of at least ``least_spread`` are ranked by spread and number of texts.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("t")).select(F.xxhash64("t").alias("h"), "t")
    kind = T.StructType([T.StructField("word", T.StringType()), T.StructField("spread", T.LongType()), T.StructField("n", T.LongType())])
    counts = texts.mapInArrow(_word_counts, kind).groupBy("word").agg(F.bit_count(F.bit_or("spread")).alias("spread"), F.sum("n").alias("n"))
    rank = F.col("spread") * 1000 + F.floor(F.log2("n") * 8)
    counts = stash(counts.where(F.col("spread") >= least_spread).withColumn("rank", rank), "word-counts")
    # a histogram of ranks tells where to cut, so that the driver gets the words that have room and few more
    least, have = 0, 0
    for cell in sorted(counts.groupBy("rank").agg(F.sum(F.length("word") + 1).alias("size")).collect(), reverse=True):
        least, have = cell["rank"], have + cell["size"]
        if have >= DICTIONARY_BYTES:
            break
    top = counts.where(F.col("rank") >= least).orderBy(F.desc("spread"), F.desc("n"), "word").limit(DICTIONARY_BYTES // 4)
    words = [r.word for r in top.collect()]
    drop_stash(counts)
    return dictionary(words)


def find_secrets(docs: DataFrame, primed: bytes, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``found``: spans (kind, start, end) of each whole text in code points, by start and kind.

    Kinds are assign, access and hex (fixed patterns, leftmost and not overlapping within a kind) and novel, the
    incompressible strings behind sensitive words, also where they overlap the others. Null and empty texts have none; repeated rows are
    alike; a carried column ``found`` gives way; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(primed)
    return map_texts(docs, [T.StructField("found", SPANS)], lambda: _scan(sent.value), text=text_col, keep=keep)
