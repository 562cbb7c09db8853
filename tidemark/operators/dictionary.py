"""Phrases of a dictionary in texts, with their places, and references between documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise

#: Words of a phrase at most.
LONGEST_PHRASE = 6
#: Phrases of a trie that goes to all tasks; a larger dictionary is joined.
MOST_IN_TRIE = 100_000

_WORD = re.compile(r"[\w\-]+")
HITS = "row long, start int, end int, words int, phrase string"


def leftmost_longest(hits: Iterable[tuple]) -> list[tuple]:
    """Of hits (start, end, ...), those that don't overlap an earlier, or an equally early and longer one."""
    kept, end = [], -1
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if hit[0] >= end:
            kept.append(hit)
            end = hit[1]
    return kept


def trie(phrases: Iterable[str]) -> dict:
    """Words to tries; the key "" marks the end of a phrase."""
    root: dict = {}
    for phrase in phrases:
        at = root
        for word in phrase.split(" "):
            at = at.setdefault(word, {})
        at[""] = phrase
    return root


def _words(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text)]


def _in_trie(words: list[tuple[int, int, str]], root: dict) -> Iterator[tuple]:
    for i, (start, _, first) in enumerate(words):
        at = root.get(first)
        j = i
        while at is not None:
            if "" in at:
                yield start, words[j][1], j - i + 1, at[""]
            j += 1
            at = at.get(words[j][2]) if j < len(words) else None


def _all_runs(words: list[tuple[int, int, str]], longest: int) -> Iterator[tuple]:
    for i, (start, _, _) in enumerate(words):
        for j in range(i, min(i + longest, len(words))):
            yield start, words[j][1], j - i + 1, " ".join(w for _, _, w in words[i : j + 1])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["row", "start", "end", "words", "phrase"])


#: Hits that are handed on together.
HANDED_ON = 50_000


def _scan(find, resolve: bool):
    """mapInArrow function over (row, text): the hits of each text, overlapping ones resolved or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hits = find(_words(text.as_py() or ""))
                for hit in leftmost_longest(hits) if resolve else hits:
                    out.append((row, *hit))
                    if len(out) >= HANDED_ON:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    return run


def _resolve(table: pa.Table) -> pa.Table:
    rows = [tuple(r.values()) for r in table.select(["start", "end", "words", "phrase"]).to_pylist()]
    row = table["row"][0].as_py()
    return pa.Table.from_batches([_batch([(row, *h) for h in leftmost_longest(rows)])])


def phrase_hits(texts: DataFrame, phrases: DataFrame, *, overlaps: str = "longest", most_in_trie: int = MOST_IN_TRIE) -> DataFrame:
    """Where phrases stand in texts: the columns of ``texts`` but text, then phrase, entity_id, confidence, char_start, char_end.

    ``phrases``: (entity_id, phrase, confidence); words are compared in lower case, between them a text may hold
    anything that is no word. Phrases of more than six words are left out. Of entities with one phrase, the most
    confident one has it, ties go to the smaller id. ``overlaps``: "longest" keeps the leftmost and then longest of
    overlapping hits, "all" keeps each. Null texts and empty dictionaries have no hits; repeated rows have hits each.

    A dictionary of up to ``most_in_trie`` phrases goes to all tasks as a trie of words. A larger one is joined to
    the texts' runs of words, and the hits of each text are resolved by themselves.
    """
    if overlaps not in ("longest", "all"):
        raise ValueError(f"overlaps must be longest or all, not {overlaps}")
    clean = F.concat_ws(" ", F.filter(F.split(F.lower("phrase"), "\\s+"), lambda w: w != ""))
    known = phrases.filter("phrase is not null and entity_id is not null").select("entity_id", clean.alias("phrase"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    known = known.filter((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) <= LONGEST_PHRASE))
    best = F.min(F.struct((-F.col("confidence")).alias("minus"), "entity_id")).alias("best")
    known = materialise(known.groupBy("phrase").agg(best).select("phrase", "best.entity_id", (-F.col("best.minus")).alias("confidence")), "dictionary-phrases")
    kept = [c for c in texts.columns if c != "text"]
    rows = materialise(texts.withColumn("dictionary_row", F.monotonically_increasing_id()), "dictionary-texts")
    read = rows.select("dictionary_row", "text")
    few = known.select("phrase").limit(most_in_trie + 1).collect()
    if len(few) <= most_in_trie:
        root = trie(r.phrase for r in few)
        hits = read.mapInArrow(_scan(lambda words: _in_trie(words, root), overlaps == "longest"), HITS)
    else:
        runs = read.mapInArrow(_scan(lambda words: _all_runs(words, LONGEST_PHRASE), False), HITS)
        hits = runs.join(known.select("phrase"), "phrase").select("row", "start", "end", "words", "phrase")
        hits = hits.groupBy("row").applyInArrow(_resolve, HITS) if overlaps == "longest" else hits
    named = hits.join(known, "phrase").select(F.col("row").alias("dictionary_row"), "phrase", "entity_id", "confidence", F.col("start").alias("char_start"), F.col("end").alias("char_end"))
    return rows.select("dictionary_row", *kept).join(named, "dictionary_row").drop("dictionary_row")


def linked_entities(hits: DataFrame, key: str, *, least: float = 0.0) -> DataFrame:
    """(key, entity_id, confidence, mentions, first_start) of each text's entities, by the most confident of their phrases."""
    kept = hits.filter(F.col("confidence") >= least)
    return kept.groupBy(key, "entity_id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("mentions"), F.min("char_start").alias("first_start"))


def descendants(parents: DataFrame, root: str, *, most_rounds: int = 100) -> DataFrame:
    """(entity_id) of ``root`` and everything below it in ``parents`` (entity_id, parent_id); cycles end by themselves."""
    spark = parents.sparkSession
    found = spark.createDataFrame([(root,)], parents.select("entity_id").schema)
    edge = parents.select("entity_id", "parent_id").distinct()
    front = found
    for _ in range(most_rounds):
        below = edge.join(front.withColumnRenamed("entity_id", "parent_id"), "parent_id").select("entity_id").distinct()
        front = materialise(below.join(found, "entity_id", "left_anti"), "dictionary-scope")
        if front.isEmpty():
            break
        found = found.unionAll(front)
    return found


#: Forms of references to circulars and directions (fixed values).
REFERENCES = (
    r"\b(RBI\/\d{4}-\d{2,4}\/\d+)\b",
    r"\b((?:DBOD|RPCD|DOR|FIDD|DNBR|FMD|DGBA|FMOD|IDMD|DPSS|FEMA)(?:\.[A-Za-z0-9_\-]+)+(?:\/[A-Za-z0-9_\-\.\(\)]+)*)\b",
    r"\b((?:DBOD|RPCD|DOR|FIDD|DNBR|FMD|DGBA|FMOD|IDMD|DPSS)(?:\.CO)?(?:\.[A-Za-z0-9_\-]+)*\.No\.[A-Za-z0-9\.\-\/\(\)\s]+?"
    r"(?=\s+(?:dated|dated\s+|January|February|March|April|May|June|July|August|September|October|November|December|\d{1,2}[\.\/\-]\d{1,2}[\.\/\-]\d{2,4}|\n|$)))",
    r"\b(SEBI\/[A-Za-z0-9_\-\/]+|CIR\/[A-Za-z0-9_\-\/]+|HO\/\([0-9]+\)[A-Za-z0-9_\-\/]+)\b",
    r"\b(?:Master\s+Direction|Master\s+Circular)\s*[-:–—]\s*([A-Za-z0-9\.\-\/\(\)]+)\b",
)
_OFFICES = tuple(f"{x}." for x in ("dbod", "rpcd", "dor", "fidd", "dnbr", "fmd", "dgba", "fmod", "idmd", "dpss", "fema"))
#: How references of each form begin, in lower case, and what else they hold.
BEGINNINGS = ((("rbi/",), ""), (_OFFICES, ""), (_OFFICES, ".no."), (("sebi/", "cir/", "ho/("), ""), (("master",), ""))
#: Letters beyond ASCII that match ASCII ones whatever the case.
_ODD = re.compile("[\u0130\u0131\u017f\u212a]")
_SPACE = re.compile(r"\s+")
#: Characters of a text that may hold references, and of a reference.
SHORTEST_TEXT, SHORTEST_REFERENCE = 100, 5
AROUND = 40
#: Characters of a beginning by which identifiers find each other.
GRAM = 5


def _matches(form: re.Pattern, beginnings: tuple[str, ...], text: str, low: str | None) -> Iterator[re.Match]:
    """What ``form.finditer`` finds, looked for only where the text begins like it; all over the text if ``low`` is None."""
    if low is None:
        yield from form.finditer(text)
        return
    starts = []
    for begin in beginnings:
        i = low.find(begin)
        while i >= 0:
            starts.append(i)
            i = low.find(begin, i + 1)
    end = 0
    for i in sorted(starts):
        if i >= end and (m := form.match(text, i)):
            yield m
            end = m.end()


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms = [(re.compile(p, re.IGNORECASE), *how) for p, how in zip(REFERENCES, BEGINNINGS, strict=True)]
    for batch in batches:
        at, out = [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if not text or len(text) < SHORTEST_TEXT:
                continue
            low, seen = None if _ODD.search(text) else text.lower(), set()
            for form, beginnings, inside in forms:
                if low is not None and inside not in low:
                    continue
                for m in _matches(form, beginnings, text, low):
                    name = _SPACE.sub(" ", m.group(1).strip().rstrip(".,;:)"))
                    if len(name) < SHORTEST_REFERENCE or not ("." in name or "/" in name) or (name, m.start()) in seen:
                        continue
                    seen.add((name, m.start()))
                    at.append(i)
                    out.append((name, m.start(), m.end(), text[max(0, m.start() - AROUND) : m.end() + AROUND].strip()))
        if at:
            own = batch.take(pa.array(at))
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], *columns], [*own.schema.names[:-1], "reference", "char_start", "char_end", "context"])


def references(texts: DataFrame, key: str) -> DataFrame:
    """(key, reference, char_start, char_end, context) of each reference to a circular; texts below 100 characters and null ones have none."""
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(_references, f"`{key}` {kind}, reference string, char_start int, char_end int, context string")


def _like_inner(outer: DataFrame, text: str, inner: DataFrame) -> DataFrame:
    """``outer`` with ``part``: the parts of its ``text`` that begin like a text of ``inner`` (inner) and are as long as one that begins so."""
    begin = F.substring("inner", 1, GRAM)
    begins = materialise(inner.groupBy(begin.alias("begin")).agg(F.collect_set(F.length("inner")).alias("lengths")), "containments-begins")
    sizes = sorted(r[0] for r in begins.select(F.length("begin")).distinct().collect())  # at most GRAM of them
    places = F.sequence(F.lit(1), F.length(text))
    at = F.flatten(F.transform(places, lambda i: F.array(*(F.struct(i.alias("from"), F.substring(F.col(text), i, F.lit(n)).alias("begin")) for n in sizes)))) if sizes else F.expr("cast(array() as array<struct<from: int, begin: string>>)")
    met = outer.filter(F.length(text) > 0).select("*", F.inline(at)).join(begins, "begin")
    fits = F.filter("lengths", lambda n: F.col("from") + n <= F.length(text) + 1)
    return met.withColumn("long", F.explode(fits)).select(*outer.columns, F.substring(F.col(text), F.col("from"), F.col("long")).alias("part"))


def containments(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): the texts of column ``inner`` that stand inside texts of column ``outer`` (both short, distinct and not empty).

    Parts of a text that begin like an inner one are joined by the whole of them, so what is joined grows with the length
    of the texts and not with how many begin alike.
    """
    parts = _like_inner(outer.select("outer"), "outer", inner).distinct()
    return inner.select("inner").join(parts.withColumnRenamed("part", "inner"), "inner").select("inner", "outer")


def resolved(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``target``: the manifest's document of a reference, or null.

    ``manifest``: (place, name, target). The last document by place whose name equals the reference (whatever the
    case) is taken, else the first of which one name holds the other.
    """
    names = manifest.filter("name <> ''").select("place", F.upper("name").alias("name"), "target")
    first = names.groupBy("name").agg(F.min("place").alias("place"), F.min_by("target", "place").alias("target"), F.max_by("target", "place").alias("exact"))
    first = materialise(first, "references-names")
    found = materialise(found.withColumn("clean", F.upper("reference")), "references-found")
    exact = first.select(F.col("name").alias("clean"), "exact")
    asked = materialise(found.select("clean").distinct().join(exact, "clean", "left"), "references-asked")
    # only references that no name equals need one that holds them or that they hold
    vague = asked.filter("exact is null and clean <> ''").select("clean")
    inside = _like_inner(vague, "clean", first.select(F.col("name").alias("inner"))).join(first.select(F.col("name").alias("part"), "place", "target"), "part").select("clean", "place", "target")
    around = _like_inner(first.select("name", "place", "target"), "name", vague.select(F.col("clean").alias("inner"))).groupBy(F.col("part").alias("clean")).agg(F.min("place").alias("place"), F.min_by("target", "place").alias("target"))
    partly = inside.unionAll(around.join(vague, "clean", "left_semi")).groupBy("clean").agg(F.min_by("target", "place").alias("partly"))
    targets = asked.join(partly, "clean", "left").select("clean", F.coalesce("exact", "partly").alias("target"))
    return found.join(targets, "clean", "left").drop("clean")
