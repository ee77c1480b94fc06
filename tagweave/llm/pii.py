"""Personal data: fixed patterns find seeds, their contexts become patterns, and trusted contexts find more."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, sliced, with_columns, written

KINDS = ("email", "ip", "card", "phone")
#: Longer words stand in a context as a digest.
LONG_WORD = 64
#: A context is trusted with so many different known instances, and such a share of all its instances.
LEAST_KNOWN, LEAST_CONFIDENCE = 3, 0.8
#: Contexts, up to which their table is broadcast; beyond, the join shuffles.
CONTEXTS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# a match never begins inside a run of digits: the run's own beginning would have matched, or what follows it can't
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_SIGN = re.compile(r"[0-9@]+")
_DIGITS = re.compile(r"[0-9]").findall
_ANY_DIGIT = re.compile("[0-9]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").finditer
#: Digits and what stands between them in numbers; the group is what ends a run of such words.
_NUMERIC = re.compile(r"[0-9+()./-]*[0-9][0-9+()./-]*([,;:!?]*)").fullmatch
_EDGE = "\"'`()[]{}<>,.;:!?|#*$%&="


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @ that a domain follows, from where the last match ended."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN(text, at + 1) if start < at else None
        if m:
            floor = m.end()
            out.append((start, floor))
        at = text.find("@", m.end() if m else at + 1)
    return out


def luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns and checks find, in this order."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP(text) if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups())]
    for m in _CARD(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _DIGITS(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE(text) if 10 <= len(_DIGITS(m[0])) <= 15]
    return sorted(out)


def words_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORDS(text)]


def identifiers(text: str, words: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Whole words with a digit or an @ that touch none of the spans taken, without punctuation at their edges, 4 characters
    at least. Neighbouring words of digits and +-./() with single spaces between them are one."""
    starts, out, run, k, before = [a for a, _ in words], [], [], 0, -1

    def close() -> None:
        start, end = run[0], run[1]
        while start < end and text[start] in _EDGE:
            start += 1
        while start < end and text[end - 1] in _EDGE:
            end -= 1
        if start > run[0] and text[start - 1] == "(" and ")" in text[start:end]:
            start -= 1
        if end - start >= 4:
            out.append((start, end))
        run.clear()

    for m in _SIGN.finditer(text):
        i = bisect_right(starts, m.start()) - 1
        if i == before:
            continue
        a, b = words[i]
        while k < len(taken) and taken[k][2] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        numeric = _NUMERIC(text, a, b)
        goes_on = run and numeric and run[2] and i == before + 1 and a == run[1] + 1 and text[run[1]] == " "
        if run and not goes_on:
            close()
        if run:
            run[1:] = [b, not numeric[1]]
        else:
            run += [a, b, bool(numeric) and not numeric[1]]
        before = i
    if run:
        close()
    return out


def _word(text: str) -> str:
    """A word of a context: lower case, digits as 0; of long ones a digest, so that contexts stay small and differ as the
    words do."""
    word = _ANY_DIGIT.sub("0", text.lower())
    return word if len(word) <= LONG_WORD else "#" + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def contexts(text: str, words: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """The two words before, and the word before with the word behind; ^ and $ stand for the text's beginning and end. What
    an identifier is joined to without a space counts as a word of its own."""
    i = bisect_right(words, (start, len(text) + 1)) - 1
    j = bisect_right(words, (end - 1, len(text) + 1)) - 1
    left = ([text[words[i][0] : start]] if words[i][0] < start else []) + [text[a:b] for a, b in reversed(words[max(0, i - 2) : i])]
    right = text[end : words[j][1]] if words[j][1] > end else text[slice(*words[j + 1])] if j + 1 < len(words) else "$"
    left = [_word(x) for x in left[:2]] or ["^"]
    return [f"{' '.join(reversed(left))} _", f"{left[0]} _ {_word(right)}"]


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of several kinds, sorted, as spans that don't overlap."""
    out: list[tuple[int, int, int]] = []
    for a, k, z in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(z, out[-1][2]))
        else:
            out.append((a, k, z))
    return out


def digest(identifier: str) -> bytes:
    """What tells different identifiers apart, whatever their length and case."""
    return hashlib.blake2b(identifier.lower().encode(), digest_size=16).digest()


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
_SEEN = T.StructType([*_SPAN.fields, T.StructField("instance", T.BinaryType()), T.StructField("contexts", T.ArrayType(T.StringType()))])


def scan(docs: DataFrame) -> DataFrame:
    """Each row's base spans, and what has contexts: the base spans and the identifiers of no known kind (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        seen = pa.struct([*span, pa.field("instance", pa.binary()), pa.field("contexts", pa.list_(pa.string()))])
        for b in sliced(batches):
            spans, found = [], []
            for text in b.column("text").to_pylist():
                if not text or not _SIGN.search(text):
                    spans.append([])
                    found.append([])
                    continue
                base = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": z} for a, k, z in base])
                words = words_of(text)
                every = [*base, *((a, -1, z) for a, z in identifiers(text, words, merged(base)))]
                found.append([{"start": a, "kind": k, "end": z, "instance": digest(text[a:z]), "contexts": contexts(text, words, a, z)} for a, k, z in every])
            sha = [hashlib.sha256(",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in x).encode()).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(range(row, row + b.num_rows), pa.int64()), pa.array(spans, pa.list_(span)), pa.array(sha), pa.array(found, pa.list_(seen))], names=names)
            row += b.num_rows

    fields = [docs.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("base_sha256", T.StringType()), T.StructField("seen", T.ArrayType(_SEEN))]
    names = [f.name for f in fields]
    return written(with_columns(docs.select("doc_id", "text"), run, fields), "pii-scan")


def trusted(edges: DataFrame, least_known: int, least_confidence: float) -> DataFrame:
    """context, kind and confidence of the contexts whose different instances are mostly known to be of one kind."""
    by_kind = edges.groupBy("context", "kind").agg(F.count("*").alias("n"), F.sum("weight").alias("known"))
    best = by_kind.groupBy("context").agg(F.sum("n").alias("n"), F.max(F.when(F.col("kind") >= 0, F.struct("known", "kind"))).alias("best"))
    best = best.select("context", F.col("best.kind").alias("kind"), F.col("best.known").alias("known"), (F.col("best.known") / F.col("n")).alias("confidence"))
    return best.where((F.col("known") >= least_known) & (F.col("confidence") >= least_confidence)).drop("known")


def discover(found: DataFrame, rounds: int | None = None, least_known: int = LEAST_KNOWN, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Trusted contexts (context, kind, confidence) of found (instance, kind, contexts; kind -1: not known).

    Contexts and instances make a bipartite graph. In each round contexts are scored by the known among their instances, and
    instances not known by their trusted contexts: 1 - product of (1 - confidence). Those at least_confidence or above are
    known from then on, by that much. Rounds end when no instance is added (or after so many as rounds says), so whatever a
    chain of contexts leads to is found. All are grouped sums; no instance or context gathers its neighbours."""
    edges = found.select("instance", "kind", F.explode("contexts").alias("context")).groupBy("context", "instance").agg(F.max("kind").alias("kind"))
    edges = written(edges.withColumn("weight", (F.col("kind") >= 0).cast("double")), "pii-graph")
    good, known, done = written(trusted(edges, least_known, least_confidence), "pii-contexts"), None, 1
    while good.limit(1).count() and (rounds is None or done < rounds):
        open_edges = edges.where("kind < 0")
        if known is not None:
            open_edges = open_edges.join(bounded(known.select("instance"), CONTEXTS), "instance", "left_anti")
        voted = open_edges.join(bounded(good.withColumnRenamed("kind", "voted"), CONTEXTS), "context")
        score = voted.groupBy("instance", "voted").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        best = score.groupBy("instance").agg(F.max(F.struct("score", "voted")).alias("best")).where(F.col("best.score") >= least_confidence)
        more = written(best, "pii-instances")
        if not more.limit(1).count():
            break
        known = more if known is None else written(known.unionByName(more), "pii-instances")
        now = edges.join(bounded(known, CONTEXTS), "instance", "left").select(
            "context",
            "instance",
            F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("best.voted", F.lit(-1))).alias("kind"),
            F.when(F.col("kind") >= 0, F.lit(1.0)).otherwise(F.coalesce("best.score", F.lit(0.0))).alias("weight"),
        )
        good, done = written(trusted(now, least_known, least_confidence), "pii-contexts"), done + 1
    return good


def personal_data(docs: DataFrame, rounds: int | None = None, least_known: int = LEAST_KNOWN, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """doc_id, base_sha256, base and spans (arrays of start, kind, end; kind: a place in KINDS; code points, end exclusive)
    of each row. spans holds the base ones and, outside them, identifiers with a trusted context, of its kind.

    Null and empty texts have no spans; repeated rows have equal spans, and count as one instance for each different
    identifier; no rows give no rows; other columns are left out. Words and identifiers of any length are whole. Texts are read
    once; what has contexts is then a table."""
    rows = scan(docs)
    found = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    good = discover(found, rounds, least_known, least_confidence)
    hits = found.where("kind < 0").select("row", "start", "end", F.explode("contexts").alias("context")).join(bounded(good, CONTEXTS), "context")
    one = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    more = one.groupBy("row").agg(F.collect_list(F.struct("start", F.col("best.kind").alias("kind"), "end")).alias("more"))
    out = rows.join(more, "row", "left")
    return out.select("doc_id", "base_sha256", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(T.ArrayType(_SPAN))))).alias("spans"))


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array(*map(F.lit, KINDS))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", *map(count, range(4)), "base_sha256", text.alias("spans"))
