"""Token ids of whole texts by the tokenizers library, through a bounded cache of text units.

A byte-level BPE splits a text by its pattern first and merges inside the parts only. White space
after another character always begins a part, and so does a full stop or comma after a letter: a
text can be cut there and each unit be encoded by itself. Equal units are encoded once.
"""

from __future__ import annotations

import gc
import json
import re

import numpy as np

from tessera.llm.util import HELD, LONG, Cache

_UNIT = re.compile(r"(?<=\S)(?=\s)")
#: white space other than a space or a line's end, after which neither begins a part
_BLANK = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: texts that units() cuts by its pattern; the others are cut before each space and line's end
_RARE = "[ \n]{2}|[\\x00" + "".join(f"\\x{{{ord(c):x}}}" for c in _OTHER) + "]"
#: a run of these after a letter is a part of its own to the unit's end
_ENDS = ".,&%$#*!?;:"
_LOADED: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def units(text: str) -> list[str]:
    """The text cut before white space that follows another character."""
    plain = not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text)
    if plain and not any(map(text.__contains__, _OTHER)):
        return text.replace("\n", "\0\n").replace(" ", "\0 ").removeprefix("\0").split("\0")
    return _UNIT.split(text)


class UnitEncoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        #: whether units are what the file's own split and merges can't reach across; else whole texts are encoded
        self.cuts = spec.get("normalizer") is None and spec.get("post_processor") is None and spec["model"]["type"] == "BPE" and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.cache = Cache(800_000)
        pieces = self.tokenizer.get_vocab_size()
        # a piece's characters each stand for one byte; other added tokens never meet these units
        self.length = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(pieces)], np.int64)

    def alone(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def ask(self, units: list[str], into: dict) -> None:
        """Encodes units; many that begin with white space and end otherwise as one text, whose ids are cut at the units' bytes."""
        odd, plain, ended, old = [], [], [], self.cache.old
        for u in units:
            if not u:
                into[u] = b""
                continue
            if u[-1] in _ENDS and (base := u.rstrip(_ENDS))[-1:].isalpha():
                ended.append((u, base, u[len(base) :]))
                if base in into:
                    continue
                if (ids := old.get(base)) is not None:
                    into[base] = ids
                    continue
                u, into[base] = base, b""
            (plain if u[0] in " \n" and u[-1] not in _BLANK and "<|" not in u else odd).append(u)
        odd += {e for _, _, e in ended if e not in into}
        into.update(zip(odd, self.alone(odd)))
        for at in range(0, len(plain), 2048):
            some = plain[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(u.encode()) for u in some])
            cuts = 4 * (np.searchsorted(np.cumsum(self.length[ids]), ends, "left") + 1)
            whole, start = ids.tobytes(), 0
            for u, end in zip(some, cuts.tolist()):
                into[u] = whole[start:end]
                start = end
        into.update([(u, into[base] + into[end]) for u, base, end in ended])

    def ids(self, texts) -> list[bytes]:
        """texts: a list, or an Arrow column."""
        gc.disable()  # a batch makes many short-lived lists and no cycles
        try:
            return self._ids(texts)
        finally:
            gc.enable()

    def _ids(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.cuts:
            return self.alone(column.to_pylist())
        if len(self.cache.young) > self.cache.limit:
            self.cache.turn()
        # texts without runs of white space are cut by Arrow; an empty unit before a text's first white space has no ids
        rare = pc.match_substring_regex(column, _RARE)
        out: list[bytes] = [b""] * len(column)
        for places, cut in ((pc.indices_nonzero(pc.invert(rare)), True), (pc.indices_nonzero(rare), False)):
            if len(places):
                some = column.take(places)
                if cut:
                    lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(some, "\n", "\0\n"), " ", "\0 "), "\0")
                else:
                    lists = pa.array(list(map(units, some.to_pylist())), pa.list_(pa.string()))
                for i, ids in zip(places.to_pylist(), self._joined(lists)):
                    out[i] = ids
        return out

    def _joined(self, lists) -> list[bytes]:
        """The ids of each list of units: a unit is looked up once for all lists."""
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        young, old = self.cache.young, self.cache.old
        got = list(map(young.get, names))
        holes = [i for i, ids in enumerate(got) if ids is None]
        ask = []
        for i in holes:
            u = names[i]
            if (ids := old.get(u)) is None:
                ask.append(u)
            else:
                young[u] = ids
        self.ask(ask, young)
        for i in holes:
            got[i] = young[names[i]]
        for i in holes:  # a bound in entries is one in bytes only without long units
            if len(names[i]) > LONG:
                del young[names[i]]
        flat, n = np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4
        at = coded.indices.to_numpy()
        size = n[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat((np.cumsum(n) - n)[at] - ends[:-1], size)
        place += np.arange(len(place))
        whole = flat[place].tobytes()
        bounds = (4 * ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]).tolist()
        return [whole[a:z] for a, z in zip(bounds, bounds[1:])]


def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = _LOADED[path] = UnitEncoder(path)
        HELD.append(found.cache.clear)
    return _LOADED[path]
