"""Scanned text made readable: lines labelled by a hidden Markov model, words rejoined, misread words restored."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.leaks import Sieve
from inkwell.llm.names import within
from inkwell.plans.runtime import cut, ship_package, skew_join, stored

#: Bound of the sample of pages the line model is fitted on; every page is then labelled.
SAMPLE_PAGES = 1_500
#: A misread form is at most one in RATIO of the word it stands for.
RATIO = 20
#: Words that are this frequent and not misread are left out of the search for occurrences; bounds a broadcast.
COMMON_WORDS = 20_000

# Character groups scanners confuse, as read and as printed.
CONFUSED = (("c", "e"), ("f", "t"), ("f", "s"), ("ri", "n"), ("b", "h"), ("@", "a"), ("!", "i"), ("1", "l"), ("1", "i"), ("0", "o"), ("0", "O"), ("n", "u"), ("q", "g"), ("rn", "m"), ("cl", "d"), ("ii", "ü"), ("a¨", "ä"), ("o¨", "ö"), ("u¨", "ü"), ("A¨", "Ä"), ("O¨", "Ö"), ("U¨", "Ü"), ("5", "S"), ("6", "G"), ("8", "B"), ("6", "ö"), ("B", "ß"), ("n", "rt"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("vv", "w"), ("I", "l"), ("l", "I"))
#: Confusions that leave a character which no printed word has.
SIGNS = tuple((read, printed) for read, printed in CONFUSED if not read.isalpha() or read in "ﬁﬂ")
HYPHENS = "-‐¬\xad"
EDGE = ".,;:()[]{}„“”\"»«?…'‚‘’·•|"

_NUMBER = re.compile(r"(?:(?:Seite|S\.|[-–—·\[(|])\s*)?([0-9OoIlZzSBGbq]{1,4}|[ivxlIVXL]{1,7})(?:\s*/\s*[0-9OoIlZzSBGbqivx]{1,4})?\s*[-–—·\])|]?")
_DECORATED = re.compile(r"^(?:Seite|S\.|[-–—·\[(|])|/")
_LABELLED = re.compile(r"\b(?:Tel(?:efon)?|Fax|Telefax|Mobil)\b\s*[.:]")
_ADDRESS = re.compile(r"\b\d{5} [A-ZÄÖÜ]")
_MAIL = re.compile(r"\S@\S+\.\w")
_LINES = re.compile(r"\r\n|\n|\r")

_OPEN_END = frozenset(".,;:!?" + HYPHENS)
_LETTER = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]{2,}")

ZONES = ("t1", "t2", "t3", "mid", "f3", "f2", "f1")
MID, DEEP = 3, (2, 4)
TYPES = ("blank", "number", "name", "shape", "title", "contact", "text")
STATES = ("head", "number", "title", "body", "break", "contact")


def contact(line: str) -> bool:
    """Whether a line holds a labelled number, a postal code with its town, a mail or a web address."""
    if "www." in line or "://" in line or ("@" in line and _MAIL.search(line)):
        return True
    if ("Tel" in line or "Fax" in line or "Mobil" in line) and _LABELLED.search(line):
        return True
    return bool(_ADDRESS.search(line))


def lines_of(text: str) -> list[str]:
    return _LINES.split(text)


def page_number(line: str) -> bool:
    """Whether a line holds a page's number only, misread digits and Roman numerals included; a bare year is none."""
    line = line.strip()
    if len(line) > 20:
        return False
    found = _NUMBER.fullmatch(line)
    return bool(found) and (bool(_DECORATED.search(line)) or not re.fullmatch(r"(19|20)\d\d", line))


def head_key(line: str) -> str:
    """The letters of a line, without case."""
    return re.sub(r"[\W\d_]+", "", line.casefold())


def shape(line: str) -> str:
    words = _WORDS.findall(line.casefold())
    return f"{words[0]}|{len(words)}" if words else ""


def may_be_head(line: str) -> bool:
    line = line.strip()
    return bool(line) and line[-1] not in _OPEN_END and len(line) <= 90 and line.count(" ") <= 30 and len(line.split()) <= 9 and _LETTER.search(line) is not None and not page_number(line)


@functools.lru_cache(100_000)
def alike(a: str, b: str) -> bool:
    """Equal but for misread letters or a Roman page number: one edit, or bigrams that agree to three quarters."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > max(4, len(b) // 5):
        return False
    if len(b) >= 6 and within(a, b, 1) <= 1:
        return True
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) >= 0.75 * (sum(x.values()) + sum(y.values()))


def zones_of(lines: list[str]) -> list[int]:
    """Zone of each line: the first three and the last three filled ones by place, all others and blank lines in the middle."""
    filled = [i for i, line in enumerate(lines) if line.strip()]
    zone = [MID] * len(lines)
    for place in (2, 1, 0):
        if place < len(filled):
            zone[filled[place]] = place
    for place in (3, 2, 1):
        if len(filled) - place > (2 if place == 3 else 1):
            zone[filled[-place]] = len(ZONES) - place
    return zone


class Heads:
    """What heads look like all over the corpus: a sieve of shapes, of bounded size."""

    def __init__(self, sieve: Sieve) -> None:
        self.sieve, self.known = sieve, {}

    def __contains__(self, shape: str) -> bool:
        if shape not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[shape] = len(self.sieve.passed(np.array([xxhash.xxh3_64_intdigest(shape)], np.uint64))) == 1
        return self.known[shape]


def symbols(lines: list[str], first_page: bool, names: list[str], shapes: Heads | frozenset[str], company: str | None = None) -> list[int]:
    """The observation of each line: its zone and what it looks like, as one number. In an advert (``company`` given) the line that is the
    advertiser's name is its title and nothing looks like a number or a head."""
    out = []
    exact = frozenset(names)
    for at, (line, zone) in enumerate(zip(lines, zones_of(lines))):
        bare = line.strip()
        kind = 6
        if not bare:
            kind = 0
        elif company is not None:
            kind = 4 if at == 0 and company and " ".join(bare.split()) == company else 5 if contact(bare) else 6
            zone = 0 if kind == 4 else MID
        elif contact(bare):
            kind = 5
        elif zone in DEEP:
            # the third line is a head only as its publication repeats it letter by letter
            kind = 2 if may_be_head(bare) and head_key(bare) in exact else 6
            zone = zone if kind == 2 else MID
        elif zone != MID:
            if page_number(bare):
                kind = 1
            elif may_be_head(bare):
                key = head_key(bare)
                if first_page and zone == 0:
                    kind = 4
                elif any(alike(key, n) for n in names):
                    kind = 2
                elif shape(bare) in shapes:
                    kind = 3
        out.append(zone * len(TYPES) + kind)
    return out


class LineModel:
    """Hidden Markov model of a page's lines, fitted by Viterbi training from weak first beliefs."""

    def __init__(self) -> None:
        s, z, t = len(STATES), len(ZONES), len(TYPES)
        edge, anywhere = np.array([5, 2, 1, 0.2, 1, 2, 5.0]), np.ones(z)
        look = {"head": (edge, {"name": 6, "shape": 4, "text": 0.02}), "number": (edge, {"number": 10}), "title": (np.array([9, 0.1, 0.01, 0.01, 0.01, 0.01, 0.01]), {"title": 10}), "body": (anywhere * [1, 1, 1, 6, 1, 1, 1], {"text": 10, "name": 0.05, "shape": 0.3, "number": 0.05, "title": 0.3}), "break": (anywhere, {"blank": 10}), "contact": (anywhere, {"contact": 10})}
        emit = np.full((s, z, t), 1e-4)
        for k, state in enumerate(STATES):
            where, kinds = look[state]
            for kind, weight in kinds.items():
                emit[k, :, TYPES.index(kind)] += where * weight
        self.emit = np.log(emit.reshape(s, -1) / emit.sum((1, 2))[:, None])
        self.start = np.log(np.array([3, 2, 2, 4, 0.5, 0.5]) / 12)
        self.move = np.log(np.full((s, s), 1 / s))
        self.cache: dict[tuple, list[int]] = {}

    def viterbi(self, seen: tuple[int, ...]) -> list[int]:
        known = self.cache.get(seen)
        if known is None:
            score, back = self.start + self.emit[:, seen[0]], []
            for o in seen[1:]:
                step = score[:, None] + self.move
                back.append(step.argmax(0))
                score = step.max(0) + self.emit[:, o]
            known = [int(score.argmax())]
            for pointer in reversed(back):
                known.append(int(pointer[known[-1]]))
            known.reverse()
            if len(self.cache) < 50_000:
                self.cache[seen] = known
        return known

    def fit(self, pages: list[tuple[int, ...]], rounds: int = 4) -> LineModel:
        s = len(STATES)
        prior_emit, prior_move, prior_start = np.exp(self.emit), np.exp(self.move), np.exp(self.start)
        for _ in range(rounds):
            emit, move, start = prior_emit * 20, prior_move * 20, prior_start * 20
            for seen, times in Counter(p for p in pages if p).items():
                path = self.viterbi(seen)
                start[path[0]] += times
                for a, o in zip(path, seen):
                    emit[a, o] += times
                for a, b in zip(path, path[1:]):
                    move[a, b] += times
            self.emit, self.move, self.start = (np.log(x / x.sum(-1, keepdims=True)) for x in (emit, move, start))
            self.cache = {}
        assert self.emit.shape[0] == s
        return self

    def label(self, seen: list[int]) -> list[int]:
        """State of each line. Runs of plain middle lines and breaks are walked as one, which the model can't tell apart."""
        short, place = [], []
        for o in seen:
            plain = o // len(TYPES) == MID and o % len(TYPES) in (0, 6)
            if plain and short and short[-1] == -1:
                place.append(len(short) - 1)
            else:
                short.append(-1 if plain else o)
                place.append(len(short) - 1)
        body = MID * len(TYPES) + 6
        path = self.viterbi(tuple(body if o == -1 else o for o in short)) if short else []
        return [(4 if o % len(TYPES) == 0 else path[p] if short[p] != -1 else 3) for o, p in zip(seen, place)]


def compact(seen: list[int]) -> tuple[int, ...]:
    out: list[int] = []
    body = MID * len(TYPES) + 6
    for o in seen:
        o = body if o // len(TYPES) == MID and o % len(TYPES) in (0, 6) else o
        if not (out and out[-1] == body == o):
            out.append(o)
    return tuple(out)


def join_lines(lines: list[str]) -> tuple[list[str], list[str]]:
    """(tokens in order, rejoined words) of one paragraph. A hyphen at a line's end goes, but stays before a capital, where it is the word's own;
    before a conjunction it stands for a shared part and nothing is joined."""
    tokens, broken, carry = [], [], None
    for line in lines:
        words = line.split()
        if not words:
            continue
        if carry is not None:
            nxt = words[0]
            if nxt.strip(EDGE) in ("und", "oder", "bzw", "sowie", "u", "o", "bis") or not nxt[0].isalpha() and nxt[0] not in "@1!058":
                tokens.append(carry[:-1] + "-")
            else:
                words[0] = carry[:-1] + ("-" if nxt[0].isupper() else "") + nxt
                broken.append(words[0])
            carry = None
        if len(words[-1]) > 1 and words[-1][-1] in HYPHENS and any(c.isalpha() or c.isdigit() for c in words[-1]):
            carry = words.pop()
        tokens += words
    if carry is not None:
        tokens.append(carry)
    return tokens, broken


def bare_word(token: str) -> str:
    return token.strip(EDGE)


def paragraphs(lines: list[str], states: list[int]) -> list[list[str]]:
    """Body lines in runs between breaks; heads and numbers between them don't end a paragraph's word."""
    out: list[list[str]] = [[]]
    for line, state in zip(lines, states):
        if state == 3:
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def plausible(word: str) -> set[str]:
    """What a word may have been before one confusion, or before two if one of them left a sign that no word has (a digit or symbol between letters, a ligature, a lone dieresis)."""
    out = repairs(word)
    for read, printed in SIGNS:
        if read in word and (fixed := word.replace(read, printed)) != word:
            out |= {fixed} | repairs(fixed)
    out.discard(word)
    return out


def repairs(word: str) -> set[str]:
    """What a word may have been before one confusion."""
    out = set()
    for read, printed in CONFUSED:
        at = word.find(read)
        while at >= 0:
            out.add(word[:at] + printed + word[at + len(read) :])
            at = word.find(read, at + 1)
    return out


def _page_names(pages: DataFrame, publications: DataFrame | None) -> tuple[DataFrame, DataFrame, Heads]:
    """((document_id, names): what the publication's heads look like; (document_id, page_id, own): further lines of a page that its publication repeats,
    but on less than a fiftieth of its pages; the shapes heads have all over the corpus)."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at_edge, inside = [], Counter(), Counter()
            for doc, page, number, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines = lines_of(text)
                for line, zone in zip(lines, zones_of(lines)):
                    if not line.strip() or not may_be_head(line):
                        continue
                    first = number is not None and number <= 1
                    if zone == MID:
                        inside[shape(line)] += 1
                    elif zone in DEEP:
                        if not first:
                            rows.append((doc, page, head_key(line), 0, 0, shape(line)))
                    elif not first:
                        at_edge[shape(line)] += zone in (0, len(ZONES) - 1)
                        rows.append((doc, page, head_key(line), 0, 0, shape(line)))
                    elif zone == 0:
                        rows.append((doc, page, head_key(line), 1, 0, None))
            rows += [(None, None, None, 2, n, s) for s, n in at_edge.items()] + [(None, None, None, 3, n, s) for s, n in inside.items()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["document_id", "page_id", "key", "kind", "n", "shape"])

    seen = stored(pages.select("document_id", "id", "page_number", "text").mapInArrow(survey, "document_id bigint, page_id bigint, key string, kind int, n bigint, shape string"))
    total = max(1, pages.count())
    # by chance the more shapes look like heads' the more pages there are, but only as their logarithm
    stats = cut(seen.where("kind >= 2 and shape <> ''").groupBy("shape").agg(F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(0)).alias("edge"), F.sum(F.when(F.col("kind") == 3, F.col("n")).otherwise(0)).alias("inside")))
    usual = stats.where((F.col("edge") >= max(3, math.ceil(math.log2(total)))) & (F.col("edge") >= 3 * F.col("inside"))).select("shape")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column(0).to_pylist()], np.uint64).view(np.int64))], names=["h"])

    shapes = Heads(Sieve.of(cut(usual.mapInArrow(digest, "h bigint"))))
    # lines that begin like the running text of other pages repeat by chance
    prose = stats.where("inside > 0 and inside >= edge").select("shape")
    heads = seen.where("kind = 0 and document_id is not null").join(prose, "shape", "left_anti")
    counted = heads.groupBy("document_id", "key").agg(F.count_distinct("page_id").alias("pages"))
    in_doc = heads.groupBy("document_id").agg(F.count_distinct("page_id").alias("all"))
    repeated = cut(counted.where("pages >= 2").join(in_doc, "document_id").select("document_id", "key", (F.col("pages") * 50 >= F.col("all")).alias("often")))
    # those on a fiftieth of the pages or more (300 a document at most) are known to all its pages, misread too; the others to the pages they stand on
    own = cut(heads.join(repeated.where("not often and length(key) >= 4"), ["document_id", "key"]).groupBy("document_id", "page_id").agg(F.collect_set("key").alias("own")))
    repeated = repeated.where("often").select("document_id", "key")
    titles = seen.where("kind = 1 and document_id is not null").groupBy("document_id").agg(F.min("key").alias("key"))
    names = repeated.unionByName(titles)
    if publications is not None:
        stem = F.regexp_replace(F.regexp_replace(F.lower("filename"), r"\.[a-z0-9]{2,4}$", ""), "ß", "ss")
        names = names.unionByName(publications.where("id is not null and filename is not null").groupBy(F.col("id").alias("document_id")).agg(F.min(F.regexp_replace(stem, r"[^\p{L}]+", "")).alias("key")))
    names = names.where(F.length("key") >= 4).groupBy("document_id").agg(F.collect_set("key").alias("names"))
    return names, own, shapes


RECORD = "record string, record_id bigint, heads array<string>, numbers array<string>, broken array<string>, words array<string>, paragraphs array<string>"


def label_records(pages: DataFrame, occurrences: DataFrame, publications: DataFrame | None = None, keep_text: bool = False) -> DataFrame:
    """One row per page and advert with its running heads, page numbers, rejoined words, the distinct words of its running text and, with
    ``keep_text``, its paragraphs (misread words not yet restored)."""
    ship_package(pages.sparkSession)
    pages = pages.where("id is not null and text is not null").select(F.col("id").cast("bigint"), F.col("document_id").cast("bigint"), "page_number", "text")
    names, own, shapes = _page_names(pages, publications)
    spark = pages.sparkSession
    sample = pages.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PAGES)
    rows = sample.join(names, "document_id", "left").select("page_number", "text", "names").collect()  # at most SAMPLE_PAGES
    model = LineModel().fit([compact(symbols(lines_of(r[1]), r[0] is not None and r[0] <= 1, r[2] or [], shapes)) for r in rows])
    adverts = occurrences.where("id is not null and preview is not null").select(F.lit("occurrence").alias("record"), F.col("id").cast("bigint").alias("record_id"), F.lit(None).cast("int").alias("page_number"), F.col("preview").alias("text"), F.lit(None).cast("array<string>").alias("names"), F.coalesce(F.trim(F.regexp_replace("company", r"\s+", " ")), F.lit("")).alias("company"))
    shown = adverts.orderBy(F.xxhash64("record_id"), "record_id", "text").limit(SAMPLE_PAGES).select("text", "company").collect()  # at most SAMPLE_PAGES
    advert_model = LineModel().fit([compact(symbols(lines_of(r[0]), False, [], shapes, r[1])) for r in shown])
    shared = spark.sparkContext.broadcast((model, advert_model, shapes))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page_model, small, known = shared.value
        for batch in batches:
            out = []
            for record, rid, number, text, known_names, company in zip(*(batch.column(i).to_pylist() for i in range(6))):
                lines = lines_of(text)
                m = page_model if record == "page" else small
                states = m.label(symbols(lines, number is not None and number <= 1, known_names or [], known, company))
                words, broken, texts = {}, {}, []
                for part in paragraphs(lines, states):
                    tokens, joined = join_lines(part)
                    words.update(dict.fromkeys(map(bare_word, tokens)))
                    broken.update(dict.fromkeys(map(bare_word, joined)))
                    if keep_text:
                        texts.append(" ".join(tokens))
                heads = dict.fromkeys(x.strip() for x, s in zip(lines, states) if s == 0)
                numbers = dict.fromkeys(x.strip() for x, s in zip(lines, states) if s == 1)
                out.append((record, rid, list(heads), list(numbers), [w for w in broken if len(w) > 1], [w for w in words if len(w) > 1 and not w.isdigit()], texts))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), *[pa.list_(pa.string())] * 5))], names=["record", "record_id", "heads", "numbers", "broken", "words", "paragraphs"])

    with_names = skew_join(pages.withColumn("document_id", F.coalesce("document_id", F.lit(-1))), names, ["document_id"], "id", "left")
    if not own.isEmpty():
        with_names = with_names.join(own.withColumnRenamed("page_id", "id"), ["document_id", "id"], "left").withColumn("names", F.coalesce(F.concat("names", "own"), "names", "own"))
    unified = with_names.select(F.lit("page").alias("record"), F.col("id").alias("record_id"), "page_number", "text", "names", F.lit(None).cast("string").alias("company")).unionByName(adverts)
    return unified.mapInArrow(label, RECORD)


def corrections(lexicon: DataFrame) -> DataFrame:
    """(word, printed): misread words with the word they stand for, the most frequent of those one confusion away that are RATIO
    times as frequent and occur five times at least. ``lexicon``: word, n."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, printed = [], [], []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if any(x.isalpha() for x in w):
                    for v in plausible(w):
                        word.append(w)
                        n.append(c)
                        printed.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(printed, pa.string())], names=["word", "n", "printed"])

    proposed = lexicon.mapInArrow(propose, "word string, n bigint, printed string")
    backed = proposed.join(lexicon.select(F.col("word").alias("printed"), F.col("n").alias("m")), "printed").where((F.col("m") >= 5) & (F.col("m") >= RATIO * F.col("n")))
    return backed.groupBy("word").agg(F.max(F.struct("m", "printed")).alias("best")).select("word", F.col("best.printed").alias("printed"))


def _restored_words(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((word, printed) of all misread words, (record, record_id, word, printed) of their occurrences)."""
    lexicon = stored(labelled.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    wrong = stored(corrections(lexicon))
    common = lexicon.join(wrong, "word", "left_anti").orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word")
    rare = labelled.select("record", "record_id", F.explode("words").alias("word")).join(F.broadcast(common), "word", "left_anti")
    return wrong, rare.join(wrong, "word")


def find_noise(pages: DataFrame, occurrences: DataFrame, publications: DataFrame | None = None) -> DataFrame:
    """(record, record_id, kind, restored), distinct: what the scanner did to each text and how it is put right.

    Kinds: running_head and page_number (lines of a page's top or foot that don't belong to its text), broken_word (rejoined over
    a line's end) and misread (restored by the words of the whole corpus). Null and empty texts and rows without id give nothing; repeated
    rows give one row. Lines are labelled by a hidden Markov model whose observations are a line's place on the page and whether it looks like a
    number, like the publication's name or a line that its pages repeat, or like heads elsewhere in the corpus.
    """
    labelled = stored(label_records(pages, occurrences, publications))
    wrong, misread = _restored_words(labelled)
    broken = labelled.select("record", "record_id", F.explode("broken").alias("word")).join(wrong, "word", "left")
    parts = [
        labelled.select("record", "record_id", F.lit("running_head").alias("kind"), F.explode("heads").alias("restored")),
        labelled.select("record", "record_id", F.lit("page_number").alias("kind"), F.explode("numbers").alias("restored")),
        broken.select("record", "record_id", F.lit("broken_word").alias("kind"), F.coalesce("printed", "word").alias("restored")),
        misread.select("record", "record_id", F.lit("misread").alias("kind"), F.col("printed").alias("restored")),
    ]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def restore_text(pages: DataFrame, occurrences: DataFrame, publications: DataFrame | None = None) -> DataFrame:
    """(record, record_id, text): each text as readable paragraphs, a blank line between them, without heads, page numbers and contact lines,
    divided and misread words restored; the empty text where nothing is left. One row per id."""
    labelled = stored(label_records(pages, occurrences, publications, keep_text=True).dropDuplicates(["record", "record_id"]))
    _, misread = _restored_words(labelled)
    by_record = misread.groupBy("record", "record_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "printed"))).alias("printed"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for parts, printed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                known = dict(printed or [])
                if known:
                    parts = [" ".join(t.replace(b, known[b]) if (b := bare_word(t)) in known else t for t in p.split(" ")) for p in parts]
                texts.append("\n\n".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["record", "record_id", "text"])

    joined = labelled.select("record", "record_id", "paragraphs").join(by_record, ["record", "record_id"], "left")
    return joined.mapInArrow(apply, "record string, record_id bigint, text string")
