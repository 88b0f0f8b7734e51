"""Ids of whole texts from the tokenizers library, remembering the ids of pieces that come again.

Both kinds of vocabulary cut a text at blanks before any merge, so a text's ids are those of its blank-separated pieces
one after the other, unless an added token stands in it. Most pieces of a corpus repeat; a worker looks the ids of those that came lately up as bytes.
"""

from __future__ import annotations

import re

# Bytes of pieces and ids that a worker's memory holds before it starts anew beside the older half; results don't depend on it.
REMEMBERED = 96_000_000
# What a piece takes: its place in the dictionary and the heads of two objects, and for each character some bytes of text and ids.
HEADS, PER_CHARACTER = 180, 5
ENCODE_AT_ONCE = 2_000
# Where cutting before a blank would cut inside a run of white space that the byte-level pattern takes as one piece.
_UNSAFE = re.compile(r"\s \s|\s $")
_BEFORE_BLANK = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
# A word and the ASCII marks after it, which both kinds of vocabulary cut apart.
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)\Z")
_encoders: dict[tuple[str, str], "Encoder"] = {}


class _ByteLevel(dict):
    """What the byte-level step of the library makes of each character."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.step = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        value = self[code] = self.step.pre_tokenize_str(chr(code))[0][0]
        return value


class _Memory:
    """Ids of the pieces that came lately. What came since the last turn is in ``now``; a piece of the half before is taken over when it
    comes again, so that frequent pieces stay and rare ones go, and at most two halves are held."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    def turn(self, most: int) -> None:
        """Let the older half go if the other one holds ``most`` bytes."""
        if self.size > most:
            self.now, self.before, self.size = {}, self.now, 0

    def unknown(self, pieces: set[str]) -> list[str]:
        """Those of ``pieces`` that are to be learnt; the others are in ``now`` after it."""
        now, before = self.now, self.before
        new = [x for x in pieces if x not in now]
        now.update({x: before[x] for x in new if x in before})
        self.size += HEADS * len(new) + PER_CHARACTER * sum(map(len, new))
        return [x for x in new if x not in now] if before else new


class Encoder:
    """``ids(texts, end_id)``: for each text the ids as little-endian unsigned 32-bit integers, end id included.

    ``spaces``: "dropped" where the vocabulary ignores white space and case, "kept" where a blank belongs to the word after it.
    """

    def __init__(self, path: str, spaces: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of added tokens have ids of their own, as in the library; texts with one are left to it whole.
        # Those the library looks for in the normalised text are looked for in lower case.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.folded = [t.content.lower() for t in added if t.normalized]
        self.model = self.tokenizer.model
        self.spaces, self.remembered = spaces, remembered
        self.bytes = _ByteLevel()
        # Ids of pieces at the start of a text, and of those after a blank.
        self.first = _Memory()
        self.later = self.first if spaces == "dropped" else _Memory()

    @classmethod
    def of(cls, path: str, spaces: str, remembered: int = REMEMBERED) -> "Encoder":
        """This worker's encoder of a vocabulary file."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if (path, spaces) not in _encoders:
            _encoders[path, spaces] = cls(path, spaces)
        _encoders[path, spaces].remembered = remembered
        return _encoders[path, spaces]

    def _word(self, word: str, blank: str) -> bytes:
        """Ids of one word: no step before the merges would cut it, so it goes to the model as bytes."""
        found = self.model.tokenize((blank + word).translate(self.bytes))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _learn(self, known: _Memory, pieces: set[str], blank: str) -> None:
        """Ids of new pieces: words by the model, what may be cut further by the whole library."""
        now, before, marked, rest = known.now, known.before, self.first.now, []
        for piece in known.unknown(pieces):
            found = _WORD_AND_MARKS.match(piece)
            # Below U+0130 a letter has one lower case and is composed.
            if not found or not found[1].isalpha() or max(found[1]) >= "\u0130":
                rest.append(piece)
                continue
            word, marks = found[1].lower() if self.spaces == "dropped" else found[1], found[2]
            if word not in now:
                now[word] = before.get(word) or self._word(word, blank)
                known.size += HEADS + PER_CHARACTER * len(word) if word != piece else 0
            if marks:
                if marks not in marked:
                    marked[marks] = self._whole([marks])[0]
                    self.first.size += HEADS + PER_CHARACTER * len(marks)
                now[piece] = now[word] + marked[marks]
            elif word != piece:
                now[piece] = now[word]
        for i in range(0, len(rest), ENCODE_AT_ONCE):
            part = rest[i : i + ENCODE_AT_ONCE]
            now.update(zip(part, self._whole([blank + x for x in part])))

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str] | None:
        """Pieces between blanks; None if the text can't be cut there."""
        for x in self.added:
            if x in text:
                return None
        if self.folded and any(x in text.lower() for x in self.folded):
            return None
        if self.spaces == "dropped":
            return text.replace("\n", " ").split(" ")
        if any(x in text for x in _BEFORE_BLANK) and _UNSAFE.search(text):
            return None
        return text.split(" ")

    def ids(self, texts: list[str | None], end_id: int) -> list[bytes]:
        for memory in (self.first, self.later):
            memory.turn(self.remembered)
        end = int(end_id).to_bytes(4, "little")
        cut = [self._cut(t) if t else [] for t in texts]
        self._learn(self.first, {c[0] for c in cut if c}, "")
        self._learn(self.later, set().union(*[c for c in cut if c]), "" if self.spaces == "dropped" else " ")
        first, later = self.first.now, self.later.now
        get, out = later.__getitem__, []
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out.append(self._whole([text])[0] + end)
            elif pieces:
                out.append(b"".join([first[pieces[0]], *map(get, pieces[1:]), end]))
            else:
                out.append(end)
        return out


def texts_of(batch, column: str, at_once: int = 128):
    """Row numbers and texts of an Arrow batch, some at a time."""
    values = batch.column(batch.schema.get_field_index(column))
    for i in range(0, batch.num_rows, at_once):
        yield i, values.slice(i, at_once).to_pylist()
