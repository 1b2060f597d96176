"""Exact byte-pair encoding by backtracking over longest matches, and decoding by offsets.

A word is a string of base symbols, the last of which carries the end-of-word mark. One pass of an
Aho-Corasick automaton finds the longest token at every place. Tokens are then laid left to right:
the longest first, then shorter ones that begin the same way, and back a step where nothing fits.
A token fits after another if merging the two texts together gives just these two tokens. That is
a table of pairs, filled as pairs turn up; a path of fitting neighbours is the merge result, and
there is only one, so places that led nowhere are never tried twice.
"""

from __future__ import annotations

import json
import pickle
from array import array

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from wageband.llm.common import with_arrow_columns

END = "</w>"
# Pre-tokenizer pattern and white space of the tokenizer file (fixed values).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space that str.split() has and the pattern's \s has not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
# Letters and numbers that the tokenizer's pattern knows from Unicode 16 (fixed values), first to last.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
# Capitals of Unicode 16 and 17 (fixed values): first, last, distance to the small letter.
LATER_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
# Below this code point every version of the letter tables agrees.
SETTLED = 0x530
CACHED_CHUNKS = 200_000
CACHED_WORDS = 200_000
# Characters of text, and chunks of them, whose new words are worked out together.
LEARNT_CHARS = 2_000_000
LEARNT_CHUNKS = 500_000
# The same for a result of ids, which as numbers are ten times their decimal text.
NUMBERED_CHARS = 500_000
CACHED_PAIRS = 2_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, free = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in plain else free))
        free += b not in plain
    return letters


class BpeTables:
    """Vocabulary, merge trees, pair ranks and the automaton of a word BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.letters = byte_letters()
        size = max([*self.ids.values(), *self.special.values()]) + 1
        names = [""] * size
        for name, number in [*self.ids.items(), *self.special.items()]:
            names[number] = name
        # Offset table: the text of token i, closed by a blank, is blob[at[i]:at[i + 1]].
        self.blob, self.at = "".join(n + " " for n in names), array("l", [0])
        for name in names:
            self.at.append(self.at[-1] + len(name) + 1)
        never = len(model["merges"])
        self.rank, self.left, self.right = [never] * size, [-1] * size, [-1] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            one, two, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair_rank[one, two] = rank
            self.rank[whole], self.left[whole], self.right[whole] = rank, one, two
        self.never = never
        # Pair table: a row per first token; the last row stands for the start of a word.
        self.fits: list[dict[int, bool]] = [{} for _ in range(size + 1)]
        self.known_pairs = 0
        self._build_automaton()

    def symbols(self, name: str) -> str:
        """A token as one character per base symbol; word-final ones lie 0x1000 higher."""
        if name.endswith(END) and len(name) > len(END):
            body = name[:-len(END)]
            return body[:-1] + chr(ord(body[-1]) + 0x1000)
        return name

    def _sound(self) -> list[bool]:
        """Whether merging a token's own text gives the token back."""
        sound = [False] * len(self.rank)
        order = sorted((i for i in self.ids.values()), key=lambda i: (self.left[i] >= 0, self.rank[i]))
        for i in order:
            if self.left[i] < 0:
                sound[i] = True
            else:
                a, b = self.left[i], self.right[i]
                sound[i] = sound[a] and sound[b] and self._joined_last(a, b)
        return sound

    def _joined_last(self, one: int, two: int) -> bool:
        """Whether two tokens both complete before any merge across their border."""
        return self._border(one, two, self.pair_rank[one, two])

    def _border(self, one: int, two: int, own: int | None) -> bool:
        """No merge crosses the border before both sides are complete; ``own`` may follow then.

        The tokens beside the border grow from single symbols along the inner edges of the two
        merge trees. The lowest rank goes first, and of equal ranks the leftmost.
        """
        spine, edge = [one], [two]
        while self.left[spine[-1]] >= 0:
            spine.append(self.right[spine[-1]])
        while self.left[edge[-1]] >= 0:
            edge.append(self.left[edge[-1]])
        i, j = len(spine) - 1, len(edge) - 1
        while True:
            across = self.pair_rank.get((spine[i], edge[j]), self.never)
            grow_one = self.rank[spine[i - 1]] if i else self.never
            grow_two = self.rank[edge[j - 1]] if j else self.never
            if not i and not j:
                return across == self.never or own is not None
            if across < grow_one and across <= grow_two:
                return False
            if grow_one <= grow_two:
                i -= 1
            else:
                j -= 1

    def pair_fits(self, one: int, two: int) -> bool:
        """The pair table, filled as pairs turn up; any token fits at the start of a word, -1."""
        known = self.fits[one].get(two)
        if known is None:
            if self.known_pairs >= CACHED_PAIRS:
                for row in self.fits:
                    row.clear()
                self.known_pairs = 0
            self.known_pairs += 1
            known = self.fits[one][two] = one < 0 or self._border(one, two, None)
        return known

    def _build_automaton(self) -> None:
        import ahocorasick

        sound = self._sound()
        texts = {self.symbols(n): i for n, i in self.ids.items() if sound[i]}
        self.lengths = [0] * len(self.rank)
        self.shorter = [-1] * len(self.rank)
        self.automaton = ahocorasick.Automaton()
        for text, i in texts.items():
            self.automaton.add_word(text, i)
            self.lengths[i] = len(text)
            # The next longest token that this one begins with.
            self.shorter[i] = next((texts[text[:n]] for n in range(len(text) - 1, 0, -1)
                                    if text[:n] in texts), -1)
        self.automaton.make_automaton()

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-token, which must not be empty."""
        if word.isascii() and word.isprintable():
            text = word
        else:
            letters = self.letters
            text = "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])
        text = text[:-1] + chr(ord(text[-1]) + 0x1000)
        lengths, shorter, fits, pair_fits = self.lengths, self.shorter, self.fits, self.pair_fits
        path: list[int] = []
        pos, last, token, size = 0, -1, -1, len(text)
        # Most words are their longest tokens, left to right, as these fit.
        for end, token in self.automaton.iter_long(text):
            fit = fits[last].get(token)
            if end + 1 - lengths[token] != pos or not (pair_fits(last, token) if fit is None else fit):
                break
            path.append(token)
            pos, last = end + 1, token
        if pos == size:
            return path
        # Matches come by their ends, so that of each start the longest is the last one written.
        longest = {end + 1 - lengths[token]: token for end, token in self.automaton.iter(text)}
        dead: set[int] = set()
        token = longest.get(pos, -1)
        while pos < size:
            row = fits[last]
            while token >= 0:
                end = pos + lengths[token]
                if end not in dead:
                    fit = row.get(token)
                    if pair_fits(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                pos, last, token = end, token, longest.get(end, -1)
            else:  # nothing fits here: go back, and try a shorter token there
                dead.add(pos)
                token = path.pop()
                pos -= lengths[token]
                last = path[-1] if path else -1
                token = shorter[token]
        return path

    def decode(self, ids: list[int]) -> str:
        """Texts of the tokens, joined by one blank."""
        blob, at = self.blob, self.at
        return "".join([blob[at[i]:at[i + 1]] for i in ids])[:-1]


class TextCoder:
    """Encodes and decodes whole texts, remembering the words and chunks it has met, up to a bound.

    Both are kept with their ids, as decimal texts, and, if ``decoding``, with the text that these ids
    decode to. The new ones of many texts are worked out together, each once.
    """

    def __init__(self, tables: BpeTables, decoding: bool = True):
        import unicodedata

        import regex

        self.tables, self.decoding = tables, decoding
        self.pieces = regex.compile(PIECES)
        self.spaces = regex.compile(r"\s+")
        self.marks = regex.compile("|".join(map(regex.escape, tables.special))) if tables.special else None
        self.normalize = unicodedata.normalize
        self.kinds: dict[str, str] = {}
        self.small = {c: c + step for a, b, step in LATER_CAPITALS for c in range(a, b + 1)}
        self.word_ids: dict[str, str] = {}
        self.word_text: dict[str, str] = {}
        self.chunk_ids: dict[str, str] = {}
        self.chunk_text: dict[str, str] = {}

    def learn(self, chunks: set[str]) -> None:
        """Work out the chunks that are not known, each word once; past the bound, forget others."""
        fresh = chunks.difference(self.chunk_ids)
        if not fresh:
            return
        self._make_room(chunks, len(fresh), CACHED_CHUNKS, self.chunk_ids, self.chunk_text)
        single: dict[str, str] = {}
        several: dict[str, list[str]] = {}
        for chunk in fresh:
            parts = [chunk] if chunk[0] == " " else self.chunk_words(chunk)
            if len(parts) == 1:
                single[chunk] = parts[0]
            else:
                several[chunk] = parts
        words = set(single.values()).union(*several.values())
        new = words.difference(self.word_ids)
        self._make_room(words, len(new), CACHED_WORDS, self.word_ids, self.word_text)
        encode, decode = self.tables.encode_word, self.tables.decode
        for word in new:
            ids = [self.tables.special[word[1:]]] if word[0] == " " else encode(word)
            self.word_ids[word] = " ".join(map(str, ids))
            if self.decoding:
                self.word_text[word] = decode(ids)
        sides = [(self.chunk_ids, self.word_ids), (self.chunk_text, self.word_text)]
        for of_chunk, of_word in sides[:1 + self.decoding]:
            for chunk, word in single.items():
                of_chunk[chunk] = of_word[word]
            for chunk, parts in several.items():
                of_chunk[chunk] = " ".join([of_word[w] for w in parts])

    @staticmethod
    def _make_room(wanted: set[str], more: int, most: int, *memories: dict[str, str]) -> None:
        if len(memories[0]) + more > most:
            for memory in memories:
                kept = {key: memory[key] for key in wanted if key in memory}
                memory.clear()
                memory.update(kept)

    def chunk_words(self, chunk: str) -> list[str]:
        """Pre-tokens of a text without white space and special tokens."""
        if chunk.isascii():
            return [chunk.lower()] if chunk.isalpha() else self.pieces.findall(chunk.lower())
        # Lower case letter by letter: str.lower() alone would treat a final sigma apart.
        low = self.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if ord(max(low)) < SETTLED:
            return [low] if low.isalpha() else self.pieces.findall(low)
        low = low.translate(self.small)
        shape = "".join([c if ord(c) < SETTLED else self._kind(c) for c in low])
        return [low[m.start():m.end()] for m in self.pieces.finditer(shape)]

    def _kind(self, letter: str) -> str:
        """A settled character of the same class: letter, number or other."""
        known = self.kinds.get(letter)
        if known is None:
            import unicodedata

            group, code = unicodedata.category(letter)[0], ord(letter)
            if group == "L" or any(a <= code <= b for a, b in LATER_LETTERS):
                known = "é"
            elif group == "N" or any(a <= code <= b for a, b in LATER_NUMBERS):
                known = "²"
            else:
                known = "-"
            self.kinds[letter] = known
        return known

    def split(self, text: str) -> list[str]:
        """Chunks between white space; a special token is a chunk of its own, marked by a blank."""
        if self.marks is not None and "<|" in text and self.marks.search(text):
            out, last = [], 0
            for mark in self.marks.finditer(text):
                out += self.split(text[last:mark.start()])
                out.append(" " + mark.group())
                last = mark.end()
            return out + self.split(text[last:])
        if text.isascii():
            text = text.lower()  # fewer different chunks
        if any(c in text for c in NOT_SPACE):
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def encode_chunks(self, text: str) -> list[str]:
        """Ids of every chunk between white space, as decimal texts; none is empty."""
        chunks = self.split(text)
        self.learn(set(chunks))
        return [x for x in map(self.chunk_ids.__getitem__, chunks) if x]

    def code(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """The ids of each text, as one decimal text, and what they decode to."""
        lists = [self.split(text) if text else [] for text in texts]
        if sum(map(len, lists)) <= LEARNT_CHUNKS:
            self.learn(set().union(*lists))
            return [self._joined(chunks) for chunks in lists]
        out = []
        for chunks in lists:
            parts = []
            for first in range(0, len(chunks), LEARNT_CHUNKS):
                part = chunks[first:first + LEARNT_CHUNKS]
                self.learn(set(part))
                parts.append(self._joined(part))
            out.append(tuple(" ".join(filter(None, side)) for side in zip(*parts)) if parts else ("", ""))
        return out

    def _joined(self, chunks: list[str]) -> tuple[str, str]:
        return (" ".join(filter(None, map(self.chunk_ids.__getitem__, chunks))),
                " ".join(filter(None, map(self.chunk_text.__getitem__, chunks))) if self.decoding else "")


def with_bpe(df: DataFrame, path: str, text: str = "text",
             outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``df`` with its token count, ids and decoded text under the tokenizer file at ``path``.

    ``outputs`` names the wanted columns: ``n_tokens``, ``ids`` (array), ``ids_text`` (decimal ids
    joined by one blank), ``decoded``. The file is read on the driver; its tables, whose size is
    that of the vocabulary, are broadcast. A null or empty text has no tokens and decodes to the
    empty text. Special token strings in a text become their ids, as the tokenizer does. Every row
    stands alone: repeated rows give equal results, and no text is cut. Result columns replace
    input columns of the same name.
    """
    types = {"n_tokens": "BIGINT", "ids": "ARRAY<INT>", "ids_text": "STRING", "decoded": "STRING"}
    # Pickled with its class, and unpickled for each task, so that nothing is held after it.
    tables = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(BpeTables(path)))

    # Where the ids are at hand as numbers, they are decoded text by text: no decoded words are kept in memory.
    numbered = "ids" in outputs

    def start():
        coder = TextCoder(pickle.loads(tables.value), "decoded" in outputs and not numbered)

        def code(texts):
            rows = coder.code(texts)
            numbers = [list(map(int, ids.split())) for ids, _ in rows] if numbered else []
            made = {
                "n_tokens": lambda: [ids.count(" ") + 1 if ids else 0 for ids, _ in rows],
                "ids": lambda: numbers,
                "ids_text": lambda: [ids for ids, _ in rows],
                "decoded": lambda: [*map(coder.tables.decode, numbers)] if numbered else [d for _, d in rows],
            }
            return [made[name]() for name in outputs]

        return code

    return with_arrow_columns(df, text, {name: types[name] for name in outputs}, start,
                              NUMBERED_CHARS if numbered else LEARNT_CHARS)
