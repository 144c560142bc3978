"""Token ids of whole texts, by the tokenizers library, with the ids of frequent words kept in memory."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A run of blanks with the run of other characters behind it. No pre-token of a byte-level vocabulary
# goes on from a character that is no blank to a blank, so texts may be cut there without changing an id.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
# Blanks other than single spaces and single line ends.
ODD = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c")
ODD_BEYOND_ASCII = (*"\x85\xa0     　", *map(chr, range(0x2000, 0x200B)))
MARKS = ".,;:!?|*%&$#"
# Before a piece that no space precedes.
FIRST = "\x01"
# A word of letters, as the pre-tokens of byte-level vocabularies tell them from marks.
LETTERS = "^[\x01\n]?[A-Za-zÀ-ÖØ-öø-ɏ]+$"
KEPT_CHUNKS = 800_000
KEPT_UNITS = 700_000
# Characters of texts that are encoded together.
CHARACTERS = 4_000_000
# Chunks that the library encodes in one call: what it returns is larger than the ids.
TOGETHER = 2_000
# Characters of texts with odd blanks that are cut at a time.
ODD_CHARACTERS = 1_000_000
ID = np.dtype("<u4")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers, by way of their chunks.

    ``kept`` bounds the chunks whose ids are remembered; beyond it the older half is forgotten. ``learn``
    adds the ids of unseen chunks to ``known``.
    """

    def __init__(self, kept: int = KEPT_CHUNKS):
        self.kept = kept
        self.known: dict[str, bytes] = {}

    def learn(self, chunks: Sequence[str]) -> None:
        raise NotImplementedError

    def chunk_ids(self, chunks: Sequence[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        found = list(map(self.known.get, chunks))
        unseen = [chunk for chunk, ids in zip(chunks, found) if ids is None]
        if not unseen:
            return found
        if len(self.known) + len(unseen) > self.kept:
            # The older half goes; what the chunks at hand need of it is in ``found``.
            for chunk in list(itertools.islice(self.known, max(len(self.known) // 2, len(self.known) + len(unseen) - self.kept))):
                del self.known[chunk]
        self.learn(unseen)
        known = self.known
        return [known[chunk] if ids is None else ids for chunk, ids in zip(chunks, found)]

    def encode(self, texts: Sequence[str], end: bytes = b"") -> list[bytes]:
        """Ids of each text, ``end`` appended to each."""
        plain = [i for i, text in enumerate(texts) if is_plain(text)]
        found: list[bytes] = [b""] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            own = CHUNK.findall(texts[i])
            distinct = list(dict.fromkeys(own))
            ids = dict(zip(distinct, self.chunk_ids(distinct)))
            found[i] = b"".join(map(ids.__getitem__, own)) + end
        if plain:
            for i, ids in zip(plain, self.encode_plain([texts[i] for i in plain])):
                found[i] = ids + end
        return found

    def encode_plain(self, texts: Sequence[str]) -> list[bytes]:
        """Texts whose blanks are all single are cut, and their chunks told apart, by Arrow."""
        marked = [FIRST + text.replace("\n", " \n") for text in texts]
        cut = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        ids = self.chunk_ids([as_chunk(piece) for piece in coded.dictionary.to_pylist()])
        flat = np.frombuffer(b"".join(ids), ID)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        code = coded.indices.to_numpy()
        each = lengths[code]
        stops = np.cumsum(each)
        where = np.repeat(starts[code] - (stops - each), each)
        where += np.arange(len(where))
        raw = flat[where].tobytes()
        bounds = np.concatenate([[0], stops])[cut.offsets.to_numpy()] * 4
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class Encoder:
    """Ids by the tokenizers library, by way of a memory of units.

    A unit is a chunk, or its word and the marks behind the word where that is letters alone. Units are named by
    their pieces: a single space before them is left out, ``FIRST`` tells that there was none. Their ids lie one
    behind the other in ``flat``; ``known`` has the place of each in ``starts``, ``lengths`` and ``used`` (the last call
    that needed it). ``kept`` bounds the units; beyond it those that were not used for longest are forgotten.
    """

    def __init__(self, vocabulary: str, kept: int = KEPT_UNITS):
        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # The name of a special token inside a text is ordinary text.
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        # Bytes that an id stands for: byte-level vocabularies write each byte as one character.
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.kept, self.calls = kept, 0
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths, self.used = np.zeros(0, ID), *(np.zeros(0, np.int64) for _ in range(3))

    def encode(self, texts: Sequence[str], end: bytes = b"") -> list[bytes]:
        """Ids of each text, ``end`` appended to each."""
        found: list[bytes] = [b""] * len(texts)
        plain = [i for i, text in enumerate(texts) if is_plain(text)]
        if plain:
            marked = [FIRST + texts[i].replace("\n", " \n") for i in plain]
            cut = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
            for i, ids in zip(plain, self.joined(cut.values, cut.offsets.to_numpy())):
                found[i] = ids + end
        odd = sorted(set(range(len(texts))).difference(plain))
        for part in batches([texts[i] for i in odd], ODD_CHARACTERS):
            own = [[as_piece(chunk) for chunk in CHUNK.findall(texts[i])] for i in odd[part]]
            bounds = np.cumsum([0, *map(len, own)])
            pieces = pa.array(list(itertools.chain.from_iterable(own)), pa.large_string())
            for i, ids in zip(odd[part], self.joined(pieces, bounds)):
                found[i] = ids + end
        return found

    def joined(self, pieces: pa.Array, bounds: np.ndarray) -> list[bytes]:
        """Ids of the texts whose pieces lie between consecutive bounds."""
        coded = pieces.dictionary_encode()
        flat, starts, lengths = self.piece_ids(coded.dictionary)
        code = coded.indices.to_numpy()
        each = lengths[code]
        raw = gathered(flat, starts[code], each).tobytes()
        stops = np.concatenate([[0], np.cumsum(each)])[bounds] * ID.itemsize
        return [raw[a:b] for a, b in itertools.pairwise(stops.tolist())]

    def piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces one behind the other, and where each piece's begin and how many they are."""
        bare = pc.utf8_rtrim(pieces, characters=MARKS)
        split = pc.and_(pc.match_substring_regex(bare, LETTERS), pc.not_equal(pc.binary_length(bare), pc.binary_length(pieces)))
        units = pc.if_else(split, bare, pieces).dictionary_encode()
        marks = pc.replace_substring_regex(pieces.filter(split), LETTERS.rstrip("$"), FIRST).dictionary_encode()
        places = self.places([*units.dictionary.to_pylist(), *marks.dictionary.to_pylist()])
        count = len(units.dictionary)
        # A piece is a unit and, where it is split, its marks.
        both = np.full((len(pieces), 2), -1)
        both[:, 0] = places[:count][units.indices.to_numpy()]
        both[split.to_numpy(zero_copy_only=False), 1] = places[count:][marks.indices.to_numpy()]
        each = np.where(both < 0, 0, self.lengths[both])
        flat = gathered(self.flat, self.starts[both].ravel(), each.ravel())
        lengths = each.sum(axis=1)
        return flat, np.cumsum(lengths) - lengths, lengths

    def places(self, units: list[str]) -> np.ndarray:
        """Places of the units in the memory, where unseen ones are put."""
        self.calls += 1
        found = self.seen(units)
        unseen = np.flatnonzero(found < 0)
        if len(unseen) and len(self.known) + len(unseen) > self.kept:
            self.forget(len(unseen))
            found = self.seen(units)
            unseen = np.flatnonzero(found < 0)
        # Marks may stand among the units too.
        new = dict.fromkeys(units[i] for i in unseen.tolist())
        if new:
            self.learn(list(new))
            found[unseen] = [self.known[units[i]] for i in unseen.tolist()]
        return found

    def seen(self, units: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.known.get, units, itertools.repeat(-1)), np.int64, len(units))
        self.used[found[found >= 0]] = self.calls
        return found

    def forget(self, room: int) -> None:
        """Keep what was used last: half of what may be kept, less where that leaves too little room."""
        count = max(0, min(self.kept // 2, self.kept - room))
        stay = np.sort(np.argsort(self.used, kind="stable")[max(0, len(self.used) - count) :])
        words = list(self.known)
        self.known = {words[i]: at for at, i in enumerate(stay.tolist())}
        self.flat = gathered(self.flat, self.starts[stay], self.lengths[stay])
        self.lengths, self.used = self.lengths[stay], self.used[stay]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def learn(self, units: Sequence[str]) -> None:
        """Encode unseen units."""
        near, apart = {}, {}
        for unit in units:
            if unit[0].isalnum():
                near[unit] = " " + unit
                continue
            chunk = as_chunk(unit)
            alone = chunk[0] not in " \n" or len(chunk) == 1 or is_blank(chunk[1])
            (apart if alone else near)[unit] = chunk
        ids = self.words(list(near.values()))
        single = list(apart.values())
        for at in range(0, len(single), TOGETHER):
            own = self.numbers(single[at : at + TOGETHER])
            ids.append((np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))))
        self.known.update(zip([*near, *apart], range(len(self.known), len(self.known) + len(units))))
        self.flat = np.concatenate([self.flat, *(flat for flat, _ in ids)])
        self.lengths = np.concatenate([self.lengths, *(lengths for _, lengths in ids)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.used = np.concatenate([self.used, np.full(len(units), self.calls)])

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without the offsets that a full encoding carries."""
        return [np.array(found.ids, ID) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids, and how many each has, of words that each start with a blank and end with none: one text, cut by width."""
        found = []
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            ids = self.numbers(["".join(part)])[0]
            ends = np.cumsum(pc.binary_length(pa.array(part, pa.string())).to_numpy())
            stops = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            found.append((ids, np.diff(stops, prepend=0)))
        return found


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one behind the other."""
    stops = np.cumsum(lengths)
    kind = np.int32 if len(flat) < 1 << 31 and (not len(stops) or stops[-1] < 1 << 31) else np.int64
    where = np.repeat((starts - (stops - lengths)).astype(kind), lengths)
    where += np.arange(len(where), dtype=kind)
    return flat[where]


def is_plain(text: str) -> bool:
    """No blanks but single spaces and line ends between other characters."""
    if not text or FIRST in text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, ODD)):
        return False
    return text.isascii() or not any(map(text.__contains__, ODD_BEYOND_ASCII))


def is_blank(character: str) -> bool:
    return character.isspace() and character not in "\x1c\x1d\x1e\x1f"


def as_chunk(piece: str) -> str:
    """The chunk that a piece between spaces stands for."""
    if piece[0] == FIRST:
        return piece[1:]
    return piece if is_blank(piece[0]) else " " + piece


def as_piece(chunk: str) -> str:
    """The piece that stands for a chunk."""
    if not is_blank(chunk[0]):
        return FIRST + chunk
    if chunk[0] == " " and len(chunk) > 1 and chunk[1] != FIRST and not is_blank(chunk[1]):
        return chunk[1:]
    return chunk


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """One per worker process, so that its memory serves all tasks of the process."""
    return Encoder(vocabulary)


def batches(texts: Sequence[str], characters: int = 8_000_000) -> Iterable[slice]:
    """Consecutive slices of about so many characters, at least one text each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= characters:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
