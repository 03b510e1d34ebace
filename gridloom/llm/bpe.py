"""Byte-level BPE encoding and decoding, equal to the tokenizers library's.

The vocabulary is read from a tokenizers file. Texts without long unsplit parts are split by
the file's own pattern and merged by rank, which gives the library's ids: every entry of such a
vocabulary is the one result of its own merges, so that merging by rank and merging by the list
of pairs take the same steps. Texts with characters on which the two pattern engines could
differ (code points beyond ``AGREED``) go through the library itself.

A pre-token of more than ``LONG`` characters goes through tree concatenation: both halves are
encoded (the leaves in threads), then growing windows around the join are encoded anew until
the window's first and last ids agree with both sides. All neighbours in the result then stand
next to each other in some exact encoding, which for BPE makes the whole exact.

White space of any kind counts as one pre-token too, so that no text, however long, meets the limits
of a backtracking pattern engine; time and memory grow in proportion to the text.

Strings of special tokens in a text become their ids, as the library does by default.
Null texts count as empty; empty texts have no ids. Repeated rows each get their own equal row. Empty tables
give no rows. Other columns than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens above so many characters are encoded as a tree; a leaf has at most so many.
LONG = 4096
#: Ids on each side of a join in the first window; doubled until both sides agree.
WINDOW = 8
#: Threads that encode the leaves of one long pre-token.
THREADS = 2
#: The pattern that splits text before the merges. Fixed value, as byte-level vocabularies define it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in the pattern (for a character class). Unicode's White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters up to this one are alike for both pattern engines; the tests try each.
AGREED = 0x31FF


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class ByteBPE:
    """An encoder and decoder made from a tokenizers file."""

    def __init__(self, path: str, long: int = LONG):
        from tokenizers import Tokenizer

        self.lib, self.long = Tokenizer.from_file(path), long
        self.lib.no_truncation()
        self.lib.no_padding()
        alphabet, added = byte_alphabet(), self.lib.get_added_tokens_decoder()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * size
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        import tiktoken

        ranks = {piece: i for i, piece in enumerate(self.pieces) if i not in added}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {t.content: i for i, t in added.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.unsplit = re.compile(f"[^ ]{{{long + 1}}}|[{WHITE}]{{{long + 1}}}")

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without strings of special tokens."""
        if _BEYOND.search(text):
            return self.lib.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def tree(self, unit: str, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """Ids of one pre-token of any length."""
        if len(unit) <= self.long:
            return self._plain(unit)
        if pool is None:
            with ThreadPoolExecutor(THREADS) as own:
                return self.tree(unit, own)
        leaves = [unit[i : i + self.long] for i in range(0, len(unit), self.long)]
        parts = list(pool.map(self._plain, leaves))
        while len(parts) > 1:  # neighbours are joined level by level
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two texts with no boundary between, from the ids of both."""
        width = WINDOW
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            a, b = self._to_char(left, a, -1), self._to_char(right, b, 1)
            head, tail = left[len(left) - a :], right[:b]
            window = b"".join(map(self.pieces.__getitem__, head + tail)).decode("utf-8")
            ids = self._plain(window)
            if (a == len(left) or ids[0] == head[0]) and (b == len(right) or ids[-1] == tail[-1]):
                return left[: len(left) - a] + ids + right[b:]
            width *= 2

    def _to_char(self, ids: list[int], n: int, side: int) -> int:
        """Grow a window until its outer edge is a character's."""
        while n < len(ids):
            edge = self.pieces[ids[len(ids) - n]][0] if side < 0 else self.pieces[ids[n]][0]
            if edge & 0xC0 != 0x80:
                break
            n += 1
        return n

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text without strings of special tokens, long pre-tokens by tree."""
        if len(text) > self.long and self.unsplit.search(text):
            ids = []
            for start, end in self.chunks(text):
                chunk = text[start:end]
                if self.unsplit.search(chunk):
                    for _, (start, end) in self.lib.pre_tokenizer.pre_tokenize_str(chunk):
                        ids += self.tree(chunk[start:end])
                else:
                    ids += self._plain(chunk)
            return np.asarray(ids, "<u4")
        if _BEYOND.search(text):
            return np.asarray(self._plain(text), "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def chunks(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of parts that end before a space that a character other than white space follows, always a
        boundary of the pattern: each part above the limit alone, all others next to each other together."""
        cuts = [0, *(m.start() for m in re.finditer(r"(?<!^) (?=\S)", text)), len(text)]
        out: list[tuple[int, int]] = []
        small = False
        for start, end in zip(cuts, cuts[1:]):
            if end - start <= self.long and small:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
            small = end - start <= self.long
        return out

    def encode_ids(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers."""
        if self.split_special is None or not self.split_special.search(text):
            return self._whole(text)
        parts = self.split_special.split(text)
        return np.concatenate([np.asarray([self.special[x]], "<u4") if i % 2 else self._whole(x) for i, x in enumerate(parts)])

    def encode(self, text: str) -> list[int]:
        return self.encode_ids(text).tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.pieces.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode("utf-8")


_BEYOND = re.compile(f"[^\\x00-{chr(AGREED)}\\u4e00-\\u9fa5]")


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    """One encoder for each worker process."""
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from gridloom.llm.common import slices, text_array

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or default_path())
        for batch in slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in text_array(batch).to_pylist():
                ids = bpe.encode_ids(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return apply


def tokens(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from gridloom.llm.common import slices, text_array

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or default_path())
        for batch in slices(batches):
            ids = [bpe.encode_ids(text).astype(np.int64) for text in text_array(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return apply


def encode_documents(docs, path: str | None = None):
    """(doc_id, ids array<bigint>) of every text."""
    return docs.select("doc_id", "text").mapInArrow(tokens(path), "doc_id long, ids array<bigint>")


def encode_digests(docs, path: str | None = None):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    return docs.select("doc_id", "text").mapInArrow(digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
