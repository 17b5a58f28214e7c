"""Exact encoding by a merge-type piece model, by backtracking over longest matches.

A sequence of pieces is the encoding if and only if each adjacent pair is what merging that
pair's own characters gives. So a unit is encoded from the left with the longest match of an
Aho-Corasick automaton; a piece that doesn't go with its neighbour gives way to the next shorter
one, and a bitfield keeps the positions from which no encoding went on. A text is cut where no
piece of the model can reach across, and equal units are encoded once. Pieces of equal score
(runs of spaces) are merged in the order of their places, which pairs alone don't decide: units
with them are merged step by step.

Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated
results, an empty table none; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import util

SPACE = "▁"
_LOADED: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a merge-type model that leaves texts as they are is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.id, self.score, self.byte, self.unknown = {}, {}, {}, 0
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                self.id[p.piece], self.score[p.piece] = i, p.score
            elif p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
            elif p.type == 2:
                self.unknown = i
            elif p.type == 4:
                raise ValueError("user-defined pieces are not known here")
        self.fallback = model.trainer_spec.byte_fallback
        met: dict[float, int] = {}
        for s in self.score.values():
            met[s] = met.get(s, 0) + 1
        #: pieces whose score is another's too
        self.tied = {p for p, s in self.score.items() if met[s] > 1 and len(p) > 1}
        ties = [p for p in self.tied if not any(q in p for q in self.tied if q != p)]
        self.ties = ties
        self.automaton, self.whole = ahocorasick.Automaton(), set()
        for p in self.id:
            if self.merged(p) == [p]:  # others are never the result of merging
                self.whole.add(p)
                if len(p) > 1:
                    self.automaton.add_word(p, len(p) - 1)
        self.automaton.make_automaton()
        #: pairs of characters that some piece holds: merging never reaches across others
        self.within = within = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        #: a space after another character and a line's end begin units, if no piece reaches into them
        self.cuts = not any(b == SPACE != a or b == "\n" for a, b in within)
        self.unit = re.compile(f"(?<=[^ {SPACE}])(?= )|(?<=.)(?=\n)", re.S)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache, self.segments = util.Cache(700_000), util.Cache(550_000)

    def merged(self, text: str) -> list[str]:
        """Merging step by step: the best-scored adjacent pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def go_together(self, a: str, b: str) -> bool:
        if len(self.pairs) > 700_000:
            self.pairs.clear()
        found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def backtracked(self, text: str) -> list[str]:
        n = len(text)
        if text in self.whole:  # a piece that merging gives
            return [text]
        ends: list[list[int]] = [[i] for i in range(1, n + 1)]  # a character that no piece is stays alone
        for end, length in self.automaton.iter(text):
            ends[end - length].append(end + 1)
        pairs, failed, taken, tried, at, last = self.pairs, 0, [], [], 0, None
        k = len(ends[0]) - 1
        while at < n:
            here = ends[at]
            while k >= 0:
                end = here[k]
                k -= 1
                if failed and failed >> end & 1:
                    continue
                piece = text[at:end]
                if last is None or (pairs[last, piece] if (last, piece) in pairs else self.go_together(last, piece)):
                    taken.append(piece)
                    tried.append((at, k))
                    at, last = end, piece
                    k = len(ends[at]) - 1 if at < n else 0
                    break
            else:
                if not taken:
                    raise AssertionError(f"no encoding of {text!r}")
                failed |= 1 << at
                taken.pop()
                at, k = tried.pop()
                last = taken[-1] if taken else None
        return taken

    def encode_unit(self, unit: str) -> list[int]:
        within = self.within
        base = unit.rstrip(".,")
        if self.fallback and base and base is not unit and base[-1] + unit[len(base)] not in within:
            return self.segment(base) + self.segment(unit[len(base) :])
        return self.segment(unit)

    def segment(self, part: str) -> list[int]:
        if len(part) > util.LONG:
            return self.long_segment(part)
        known = self.segments
        found = known.young.get(part)
        if found is None:
            found = known.old.get(part) or self.encode_segment(part)
            if len(known.young) > known.limit:
                known.turn()
            known.young[part] = found
        return found

    def long_segment(self, part: str) -> list[int]:
        """Not remembered as a whole, but cut wherever no piece reaches across (bytes stand for unknown characters, so they don't join)."""
        if not self.fallback:
            return self.encode_segment(part)
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.within]
        if not cuts:
            return self.encode_segment(part)
        return [i for a, z in zip([0, *cuts], [*cuts, len(part)]) for i in (self.segment if z - a <= util.LONG else self.encode_segment)(part[a:z])]

    def encode_segment(self, text: str) -> list[int]:
        if any(map(text.__contains__, self.ties)):
            return self.long_tied(text)
        parts = self.backtracked(text)
        ids = list(map(self.id.get, parts))
        return ids if None not in ids else self.spelled(parts)

    def spelled(self, parts: list[str]) -> list[int]:
        """Ids of pieces and, in bytes, of characters that no piece is."""
        ids = []
        for p in parts:
            i = self.id.get(p)
            if i is not None:
                ids.append(i)
            elif self.fallback:
                ids.extend(self.byte[b] for b in p.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def long_tied(self, unit: str) -> list[int]:
        """As merged(), with a heap: units of any length."""
        import heapq

        n = len(unit)
        part, after, before = list(unit), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i] + part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or after[i] < 0 or part[i] + part[after[i]] != both:
                continue
            j = after[i]
            part[i], part[j], after[i] = both, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return self.spelled([p for p in part if p is not None])

    def units(self, text: str) -> list[str]:
        """The text after the model's prefix, cut where no piece reaches across; spaces as they are."""
        if not self.cuts:
            return [(" " if self.prefix else "") + text]
        if "  " in text or SPACE in text or "\0" in text:
            cut = self.unit.split(text)
        else:
            cut = text.replace("\n", "\0\n").replace(" ", "\0 ").removeprefix("\0").split("\0")
        if self.prefix:
            cut[0] = " " + cut[0]
        return cut

    def encode(self, texts: list[str | None]) -> list[list[tuple[bytes, str]]]:
        """For each text its units' ids: as 32-bit bytes, and in decimals."""
        gc.disable()  # a batch makes many short-lived lists and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts):
        if len(self.cache.young) > self.cache.limit:
            self.cache.turn()
        young, old = self.cache.young, self.cache.old
        held, need = [], set()
        for text in texts:
            cut = self.units(text) if text else []
            got = list(map(young.get, cut))
            holes = [i for i, found in enumerate(got) if found is None]
            need.update([cut[i] for i in holes])
            held.append((cut, got, holes))
        for u in need:
            found = old.get(u)
            if found is None:
                ids = self.encode_unit(u.replace(" ", SPACE))
                found = (array("i", ids).tobytes(), ",".join(map(str, ids)))
            young[u] = found
        for cut, got, holes in held:
            for i in holes:
                got[i] = young[cut[i]]
        for u in need:  # a bound in entries is one in bytes only without long units
            if len(u) > util.LONG:
                del young[u]
        return [got for _, got, _ in held]


def encoder(path: str) -> PieceEncoder:
    if path not in _LOADED:
        found = _LOADED[path] = PieceEncoder(path)
        util.HELD.extend([found.cache.clear, found.segments.clear, found.pairs.clear])
    return _LOADED[path]


def encoded(docs: DataFrame, *, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text."""
    import pyarrow as pa

    model = model or default_path()

    def rows(batches):
        coder = encoder(model)
        for batch in batches:
            found = coder.encode(batch.column(1).to_pylist())
            ids = [np.frombuffer(b"".join([x for x, _ in units]), np.int32).tolist() for units in found]
            texts = [coder.library.decode(x) if x else "" for x in ids]
            columns = [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(",".join([s for _, s in units]).encode()).hexdigest() for units in found], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    util.settle(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def op4(spark, sf_dir: str) -> DataFrame:
    return encoded(util.documents(spark, sf_dir))
