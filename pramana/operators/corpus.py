"""Documents into sections and passages, passages back to places in their documents, and checks of a corpus."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.functions import text as T

# Bounds in words, and headings of sections that hold no facts.
TARGET, LEAST, MOST, OVERLAP, STUB = 170, 60, 240, 0.25, 15
SKIPPED = [
    "references", "external links", "see also", "further reading", "notes", "bibliography", "sources", "citations", "footnotes",
    "सन्दर्भ", "इन्हें भी देखें", "बाहरी कड़ियाँ", "बाहरी कडियां", "टिप्पणी", "संदर्भ", "अतिरिक्त पठन", "ग्रन्थसूची",
]
HEADING = r"(?md)^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t\r]*$"


def sections(text: Column) -> Column:
    """Array of ``pos, level, path, body``: the sections of a text by headings ``== A ==``, ``=== B ===``, ...

    The part before the first heading is "Introduction". path joins the headings a section stands under; sections of
    references and the like, and empty ones, are left out. Null text has none. Built-in functions only, and no exchange.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), HEADING, "\u0001$1\u0002$2\u0003")

    def part(p: Column, i: Column) -> Column:
        title = F.when(i == 0, "").otherwise(T.strip(F.regexp_extract(p, "(?s)\u0002(.*?)\u0003", 1)))
        level = F.when(i == 0, 1).otherwise(F.length(F.regexp_extract(p, "^(=+)\u0002", 1)) - 1)
        return F.struct(i.cast("bigint").alias("pos"), level.cast("int").alias("level"), title.alias("title"), T.strip(F.when(i == 0, p).otherwise(F.regexp_extract(p, "(?s)\u0003(.*)$", 1))).alias("body"))

    # The headings over each part: a fold that keeps those of lower level.
    start = F.struct(F.array().cast("array<string>").alias("over"), F.array().cast("array<struct<pos:bigint,level:int,path:string,body:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        over = F.when(p["pos"] == 0, acc["over"]).otherwise(F.concat(F.slice(acc["over"], 1, p["level"] - 1), F.array(p["title"])))
        path = F.when(p["pos"] == 0, "Introduction").otherwise(F.array_join(over, " > "))
        keep = (p["body"] != "") & ((p["pos"] == 0) | ~F.lower(p["title"]).isin(SKIPPED))
        return F.struct(over.alias("over"), F.when(keep, F.concat(acc["out"], F.array(F.struct(p["pos"].alias("pos"), p["level"].alias("level"), path.alias("path"), p["body"].alias("body"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.transform(F.split(marked, "\u0001"), part), start, step, lambda acc: acc["out"])


def split_sections(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, pos, level, path, body``: the sections of documents (see ``sections``)."""
    return docs.select(id_col, F.inline(sections(F.col(text_col))))


def pack(sentences: Column) -> Column:
    """Groups of sentences of about TARGET words: a group closes at TARGET, or before a sentence that would take it over MOST."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("bigint").alias("n"))
    words = lambda s: F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")).cast("bigint")

    def step(acc: Column, s: Column) -> Column:
        n = words(s)
        flush = (F.size(acc["open"]) > 0) & (acc["n"] + n > MOST)
        done = F.when(flush, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        opened = F.when(flush, F.array(s)).otherwise(F.concat(acc["open"], F.array(s)))
        size = F.when(flush, n).otherwise(acc["n"] + n)
        full = size >= TARGET
        return F.struct(F.when(full, F.concat(done, F.array(opened))).otherwise(done).alias("done"), F.when(full, F.array().cast("array<string>")).otherwise(opened).alias("open"), F.when(full, F.lit(0).cast("bigint")).otherwise(size).alias("n"))

    return F.aggregate(sentences, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def packed(sentences: list[str]) -> list[list[str]]:
    """As ``pack``, for one section of a document in a batch."""
    groups: list[list[str]] = [[]]
    size = 0
    for s in sentences:
        n = len(s.split())
        if groups[-1] and (size >= TARGET or size + n > MOST):
            groups.append([])
            size = 0
        groups[-1].append(s)
        size += n
    return [g for g in groups if g]


def _passages(parts: list[dict], version: int) -> list[list[str]]:
    """[path, text, own text] of the passages of a document's sections."""
    rows: list[list[str]] = []
    for part in parts:
        chunks = packed(part["sentences"])
        for i, chunk in enumerate(chunks):
            own = " ".join(chunk)
            lead = chunks[i - 1][-max(1, int(len(chunks[i - 1]) * OVERLAP)) :] if i else []
            body = " ".join([*lead, own])
            n = len(body.split())
            if n < LEAST:
                before = rows[-1] if rows else None
                joined = before and f"{before[1]} {body}"
                if before and (version == 1 or (before[0] == part["path"] and len(joined.split()) <= MOST)):
                    before[1], before[2] = joined, f"{before[2]} {own}"
                    continue
                if n < STUB:
                    continue
            rows.append([part["path"], body, own])
    return rows


def segment_documents(docs: DataFrame, *, version: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, passage_no, passage_id, section_path, text, text_raw, token_count`` and the columns scheme, lang and page that ``docs`` has: passages of documents.

    Sections are packed; a pack after the first of a section starts with the last quarter of the sentences before (one at
    least). A passage under LEAST words joins the one before: of the same section and together within MOST (version 2), or of
    the same document, sentences split after abbreviations too (version 1); failing that it is dropped under STUB words.
    passage_id is ``{doc_id}#p0000`` and so on. A document is a row from end to end: nothing is exchanged.
    """
    if version not in (1, 2):
        raise ValueError("version: 1 or 2")
    kinds = dict(docs.dtypes)
    more = [c for c in ("scheme", "lang", "page") if c in kinds]
    # Composed before it is cut up: the rest of normalization is of built-in functions and runs within arrays.
    composed = docs.select(F.col(id_col).alias("doc_id"), *more, T.nfc(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    clean = lambda body: T.normalize_whitespace(T.normalize_punctuation(T.normalize_digits(F.translate(body, T.ZERO_WIDTH, ""))))
    x = composed.select("doc_id", *more, F.transform(sections(F.col("text")), lambda p: F.struct(p["path"].alias("path"), T.split_sentences(clean(p["body"]), protect_abbreviations=version == 2).alias("sentences"))).alias("parts"))
    columns = ["doc_id", *more, "passage_no", "passage_id", "section_path", "text", "text_raw", "token_count"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            ids = b.column(0).to_pylist()
            for i, parts in enumerate(b.column(1 + len(more)).to_pylist()):
                for n, (path, text, own) in enumerate(_passages(parts or [], version)):
                    at.append(i)
                    out.append((n, f"{ids[i]}#p{n:04d}", path, text, own, len(text.split())))
            take = pa.array(at, pa.int64())
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(1 + len(more))], *[pa.array([r[k] for r in out], t) for k, t in enumerate(types)]], columns)

    schema = f"doc_id {kinds[id_col]}" + "".join(f", {c} {kinds[c]}" for c in more) + ", passage_no long, passage_id string, section_path string, text string, text_raw string, token_count long"
    return x.mapInArrow(build, schema)


class SourceText:
    """A document's words with their places, in the form passages have."""

    def __init__(self, text: str):
        self.spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        self.words = [_plain(text[a:b]) for a, b in self.spans]
        self.at: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.at.setdefault(w, []).append(i)

    def best_run(self, wanted: list[str], cursor: int = 0) -> tuple[int, int, int]:
        """(first, last, matched) of the offset from ``cursor`` on at which most of the wanted words stand in their places, give or take two; of equals the first."""
        votes: dict[int, int] = {}
        for j, w in enumerate(wanted):
            places = self.at.get(w, ())
            for i in places[bisect_left(places, cursor) :] if places else ():
                votes[i - j] = votes.get(i - j, 0) + 1
        if not votes:
            return 0, 0, 0
        peak = min(votes, key=lambda o: (-sum(votes.get(o + d, 0) for d in (-2, -1, 0, 1, 2)), -votes[o], o))
        hit: set[int] = set()
        matched = 0
        for j, w in enumerate(wanted):
            near = [i for i in self.at.get(w, ()) if i >= cursor and abs(i - j - peak) <= 2]
            hit.update(near)
            matched += bool(near)
        return min(hit), max(hit), matched

    def place(self, text: str, cursor: int, least: float) -> tuple[int | None, int | None, float, int]:
        """(start, end, coverage, cursor after it) of a passage: its sentences in turn, each after the one before, or anywhere if there is too little of it."""
        found, words, hits, at = [], 0, 0, cursor
        for sentence in re.split(r"(?<=[.!?।॥])\s+", text or ""):
            wanted = [_plain(w) for w in sentence.split()]
            words += len(wanted)
            got = self.best_run(wanted, at)
            if at > 0 and got[2] < least * len(wanted):
                again = self.best_run(wanted)
                got = again if again[2] > got[2] else got
            if got[2]:
                found.append(got[:2])
                hits += got[2]
                at = got[1] + 1
        coverage = hits / words if words else 0.0
        if not found or coverage < least:
            return None, None, coverage, cursor
        last = max(b for _, b in found)
        return self.spans[min(a for a, _ in found)][0], self.spans[last][1], coverage, last + 1


def _plain(word: str) -> str:
    t = unicodedata.normalize("NFC", word).translate(dict.fromkeys(map(ord, T.ZERO_WIDTH)))
    t = t.translate(str.maketrans(T.DEVANAGARI_DIGITS, "0123456789"))
    t = t.translate(str.maketrans(T.DASHES + T.QUOTES[0], "-" * len(T.DASHES) + T.QUOTES[1])).replace("­", "").replace("…", "...")
    return t.strip()


def align_spans(passages: DataFrame, documents: DataFrame, *, least: float = 0.9) -> DataFrame:
    """``passage_id, start, end, coverage, text_raw`` of ``passages`` (passage_id, doc_id, text) in ``documents`` (doc_id, text).

    Passages are placed in the order of their ids, each after the one before: so a text that stands twice is found twice. A
    sentence of which less than ``least`` is found there is looked for in the whole document. The span is from the first to the last word
    found, coverage the share of the passage's words found, text_raw what the document has there. Null start, end and text_raw under ``least``: the
    place is declined rather than guessed. A passage of a document that isn't there, or without words, has none. One document and its passages are one task's work.
    """

    def place(own: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        raw = (source["text"].iloc[0] or "") if len(source) else ""
        text, cursor, rows = SourceText(raw), 0, []
        for pid, body in sorted(zip(own["passage_id"], own["text"])):
            start, end, coverage, cursor = text.place(body, cursor, least)
            rows.append((pid, start, end, round(coverage, 6), raw[start:end] if start is not None else None))
        return pd.DataFrame(rows, columns=["passage_id", "start", "end", "coverage", "text_raw"]).astype({"start": "Int64", "end": "Int64"})

    return passages.select("passage_id", "doc_id", "text").groupBy("doc_id").cogroup(documents.select("doc_id", "text").groupBy("doc_id")).applyInPandas(place, "passage_id string, start long, end long, coverage double, text_raw string")


def repair_spans(passages: DataFrame, documents: DataFrame, *, least: float = 0.9) -> DataFrame:
    """``passages`` with the char_span and text_raw that ``align_spans`` finds; where it finds none char_span is (0, 0) and text_raw stays. Ids and texts are never changed."""
    found = align_spans(passages, documents, least=least).select("passage_id", "start", "end", F.col("text_raw").alias("__raw"))
    x = passages.join(found, "passage_id", "left")
    span = F.array(F.coalesce("start", F.lit(0)).cast("int"), F.coalesce("end", F.lit(0)).cast("int"))
    return x.withColumns({"char_span": span, "text_raw": F.coalesce("__raw", "text_raw")}).drop("start", "end", "__raw")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


# How much of a passage its span must give back and one section must hold, and from how many passages on how many may have raw texts without any trace of a source.
SPAN_FLOOR, SECTION_FLOOR, RAW_LEAST, RAW_MOST = 0.95, 0.98, 20, 0.9


def audit(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """``check_name, n, passed, rate`` of passages (passage_id, doc_id, text, text_raw, token_count, char_span) against documents (doc_id, text).

    unique_ids, nonempty_text, token_count_accurate, within_max_tokens, source_present; of passages with a document span_present,
    span_recovers_text (of those with a span) and single_section; raw_preserves_source is one check of the whole corpus. Repeated ids fail.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    counts = passages.groupBy("passage_id").agg(F.count(F.lit(1)).alias("copies"))
    sources = documents.groupBy("doc_id").agg(F.max("text").alias("source"))
    x = passages.withColumn("row", F.monotonically_increasing_id()).join(counts, "passage_id").join(sources, "doc_id", "left")
    x = x.withColumns({"text": F.coalesce("text", F.lit("")), "raw": F.coalesce("text_raw", F.lit("")), "a": F.coalesce(F.col("char_span")[0], F.lit(0)), "b": F.coalesce(F.col("char_span")[1], F.lit(0))})
    there, spanned = F.col("source").isNotNull(), (F.col("a") != 0) | (F.col("b") != 0)
    x = x.withColumns({"recovered": T.normalize_text(F.when(spanned, F.substring("source", F.col("a") + 1, F.greatest(F.col("b") - F.col("a"), F.lit(0))))), "plain": T.normalize_text(F.col("raw"))})
    # The words of each section, one row a section; a passage meets those of its own document.
    vocabulary = split_sections(sources.where("source is not null"), text_col="source").select("doc_id", words(T.normalize_text(F.col("body"))).alias("section"))
    n = T.count_tokens(F.col("text"))
    checks = {
        "unique_ids": F.col("copies") == 1,
        "nonempty_text": (T.strip(F.col("text")) != "") & (T.strip(F.col("raw")) != ""),
        "token_count_accurate": F.coalesce(F.col("token_count") == n, F.lit(False)),
        "within_max_tokens": n <= MOST,
        "source_present": there,
        "span_present": F.when(there, spanned),
        "span_recovers_text": F.when(there & spanned, jaccard(words(F.col("recovered")), words(F.col("text"))) >= SPAN_FLOOR),
    }
    of = lambda df, tests: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("ok")) for k, v in tests.items()])).alias("c")).select("c.*").where("ok is not null")
    own = x.where(there).select("row", "doc_id", words(F.col("text")).alias("w"))
    held = F.when(F.size("w") > 0, F.size(F.array_intersect("w", "section")) / F.greatest(F.size("w"), F.lit(1))).otherwise(1.0)
    single = own.join(vocabulary, "doc_id", "left").groupBy("row").agg(F.coalesce(F.max(F.when(F.col("section").isNotNull(), held)), F.lit(1.0)).alias("held"))
    untouched = x.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("raw") != "") & (F.col("plain") == F.col("raw"))).alias("same")).where(F.col("n") >= RAW_LEAST)
    long = of(x, checks).unionByName(of(single, {"single_section": F.col("held") >= SECTION_FLOOR})).unionByName(of(untouched, {"raw_preserves_source": F.col("same") / F.col("n") <= RAW_MOST}))
    return long.groupBy("check_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed")).withColumn("rate", F.round(F.col("passed") / F.col("n"), 6))


def reanchor(cited: DataFrame, old: DataFrame, new: DataFrame, *, contained: float = 0.9, piece: float = 0.2, answer: float = 0.8) -> DataFrame:
    """What became of cited passages in another segmentation: ``id, passage_id, status, new_id``.

    ``cited`` (id, passage_id, answer), ``old`` and ``new`` (passage_id, doc_id, text). status: unchanged (same id and text), moved (same
    text in the document), contained (``contained`` of its words in one passage), split-answer (just one passage with ``piece``
    of its words has ``answer`` of the answer's), else review.
    """
    words = lambda c: F.array_distinct(T.answer_tokens(c))
    o = old.select("passage_id", "doc_id", F.col("text").alias("old_text"), words(F.col("text")).alias("ow"))
    n = new.select(F.col("passage_id").alias("new_id"), "doc_id", F.col("text").alias("new_text"), words(F.col("text")).alias("nw"))
    q = cited.select("id", "passage_id", words(F.col("answer")).alias("aw"))
    x = q.join(o, "passage_id").join(n, "doc_id", "left")
    cover = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))).otherwise(0.0)
    x = x.withColumns({"c": F.coalesce(cover(F.col("ow"), F.col("nw")), F.lit(0.0)), "same": F.coalesce(F.col("old_text") == F.col("new_text"), F.lit(False))})
    x = x.withColumn("carries", (F.col("c") >= piece) & (F.size("aw") > 0) & (cover(F.col("aw"), F.col("nw")) >= answer))
    g = x.groupBy("id", "passage_id").agg(
        F.max(F.col("same") & (F.col("new_id") == F.col("passage_id"))).alias("kept"), F.min(F.when(F.col("same"), F.col("new_id"))).alias("moved"), F.max(F.struct(F.round("c", 9).alias("c"))).alias("best"),
        F.min(F.struct((-F.round("c", 9)).alias("m"), "new_id")).alias("top"), F.count_if("carries").alias("carriers"), F.min(F.when(F.col("carries"), F.col("new_id"))).alias("carrier"),
    )
    status = F.when(F.coalesce("kept", F.lit(False)), "unchanged").when(F.col("moved").isNotNull(), "moved").when(F.col("best.c") >= contained, "contained").when(F.col("carriers") == 1, "split-answer").otherwise("review")
    g = g.withColumn("status", status)
    target = F.when(F.col("status").isin("unchanged", "review"), F.col("passage_id")).when(F.col("status") == "moved", F.col("moved")).when(F.col("status") == "contained", F.col("top.new_id")).otherwise(F.col("carrier"))
    return g.select("id", "passage_id", "status", target.alias("new_id"))


def apply_reanchor(items: DataFrame, changes: DataFrame, *, version: int) -> DataFrame:
    """``items`` (id, gold_passage_ids, verified, notes, ...) with the citations that ``changes`` (of ``reanchor``) give: new ids once each in the old order,
    not verified any more, and a note, where anything changed."""
    worst = ["unchanged", "moved", "contained", "split-answer", "review"]
    rank = F.array_position(F.array(*map(F.lit, worst)), F.col("status"))
    of = changes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("passage_id", "new_id"))).alias("__to"), F.max(rank).alias("__worst"))
    x = items.join(of, "id", "left")
    changed = F.coalesce(F.col("__worst") > 1, F.lit(False))
    note = F.concat(F.lit(f"reanchored to segmentation v{version}: "), F.element_at(F.array(*map(F.lit, worst)), F.greatest(F.col("__worst"), F.lit(1)).cast("int")))
    ids = F.array_distinct(F.transform("gold_passage_ids", lambda p: F.coalesce(F.col("__to")[p], p)))
    return x.withColumns({"gold_passage_ids": F.when(changed, ids).otherwise(F.col("gold_passage_ids")), "verified": F.col("verified") & ~changed, "notes": F.when(changed, F.when(F.coalesce("notes", F.lit("")) == "", note).otherwise(F.concat("notes", F.lit("; "), note))).otherwise(F.col("notes"))}).drop("__to", "__worst")
