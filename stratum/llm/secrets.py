"""Secret scan by corpus-wide ownership frequency.

Every text is scanned once for the base kinds and for candidates: words of high entropy that no base pattern
takes, private keys with their bodies and bearer values. What is counted is the credential itself: the value that is
assigned, without its keyword and quotes; the value of a bearer; a key's body without its line breaks. So a value is the same one
wherever and however it is written. Its hash is counted over the distinct owners and repositories of the whole corpus.

A value is a copied example if it has more than max_owners owners or more than max_repositories repositories;
otherwise it belongs to its owner, is live-looking, and its span is added to the result. In a corpus of so few owners
that max_owners could not be passed, all owners but one are the most that a value may have (and 1 at least). Base spans stay
whatever their count, but are told apart in n_shared and n_owned, and the column ownership has both counts of every
value found, as kind:start:end:owners:repositories, those of dropped spans included.

Cases: a null text is empty and has no spans; a null owner or repository counts as one of its own; a null id
stays; repeated rows each give a row (their values count once for an owner and repository); an empty table
gives an empty result; other columns are not looked at; bytes that are not UTF-8 count as U+FFFD. Rows are told apart by
id and text, so that repeated ids with different texts keep their own spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sound, table
from .spans import ASSIGN, SECRET_KINDS, covered, digest, free, secret_spans

#: Kinds that the method adds, after the base ones.
ADDED = ("private_key", "bearer", "opaque")
KINDS = SECRET_KINDS + ADDED
#: A private key's header, and the rest up to its END line or else its fields and long base64 lines; line breaks may be written out.
PRIVATE_KEY = re.compile(
    r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s++[A-Z][A-Za-z-]*+:\x20[^\n]*+)*+(?:(?:\s|\\r|\\n)++[A-Za-z0-9+/]{32,}+={0,2})++(?:(?:\s|\\r|\\n)++[A-Za-z0-9+/]*+={1,2})?+)?+"
)
_BREAK = re.compile(r"\s|\\r|\\n")
_KEY_LINE = re.compile(r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----")
BEARER = re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})")
#: An opaque word: 20 or more characters of a key alphabet, with capitals, small letters and digits.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}")
ENTROPY = 3.5
#: A value with more owners, or more repositories, than these is a copied example.
OWNERS, REPOSITORIES = 2, 50

_SCHEMA = "id long, text_hash long, owner string, repository string, base_sha256 string, n_assign long, n_access long, n_hex long, found array<struct<kind:int,a:long,b:long,value:string>>"


def _entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that no base span overlaps, by start; the first kind that takes a place keeps it."""
    taken = covered(base)
    out = []
    for m in PRIVATE_KEY.finditer(text) if "PRIVATE KEY" in text else ():
        if free(taken, *m.span(1)):  # a base span in the body leaves the header
            out.append((m.start(), 3, m.end() if free(taken, *m.span()) else m.end(1)))
    taken = covered([*base, *out])
    if "earer" in text:
        out += [(m.start(1), 4, m.end(1)) for m in BEARER.finditer(text) if free(taken, *m.span(1))]
        taken = covered([*base, *out])
    for m in OPAQUE.finditer(text):
        w = m[0]
        if any(c.isupper() for c in w) and any(c.islower() for c in w) and _entropy(w) >= ENTROPY and free(taken, *m.span()):
            out.append((m.start(), 5, m.end()))
    return sorted(out)


def value_of(text: str, a: int, kind: int, b: int) -> str:
    """The credential that a span holds, which is what is counted over owners and repositories."""
    if kind == 0:
        return ASSIGN.fullmatch(text, a, b)[2]
    if kind == 3:
        key = PRIVATE_KEY.match(text, a)[0]
        return _BREAK.sub("", _KEY_LINE.sub("", key)) or _BREAK.sub("", key)
    return text[a:b]


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str, text_col: str) -> DataFrame:
    """One row per document with its owner and repository, base digest and every value found, hashed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            shas, counts, found = [], ([], [], []), []
            for x in batch.column(4):
                text = x.as_py() or ""
                base = secret_spans(text)
                shas.append(digest(base, KINDS)[1])
                n = Counter(k for _, k, _ in base)
                for k in range(3):
                    counts[k].append(n[k])
                found.append([{"kind": k, "a": a, "b": b, "value": hashlib.sha256(value_of(text, a, k, b).encode("utf-8", "surrogatepass")).hexdigest()} for a, k, b in [*base, *candidates(text, base)]])
            arrays = [*batch.columns[:4], pa.array(shas, pa.string()), *(pa.array(c, pa.int64()) for c in counts), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "text_hash", "owner", "repository", "base_sha256", "n_assign", "n_access", "n_hex", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), owner.alias("owner"), repository.alias("repository"), sound(text_col).alias("text"))
    return rows.mapInArrow(each, _SCHEMA)


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories) of rows (value, owner, repository), a repository belonging to an owner.

    Three aggregates, each combined before its shuffle: a value in a third of all rows costs no single task.
    """
    once = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secret_scan(
    docs: DataFrame, owner_col: str = "source", repository_col: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    max_owners: int = OWNERS, max_repositories: int = REPOSITORIES,
) -> DataFrame:
    """Base spans, digests and added spans of every document; see the module for the cases.

    Without a repository column each document is a repository of its owner.
    """
    owner = F.col(owner_col).cast("string")
    repository = (F.col(repository_col) if repository_col else F.col(id_col)).cast("string")
    scanned = cut(scan(docs, owner, repository, id_col, text_col))
    known = scanned.groupBy("owner").agg(F.lit(1).alias("one")).count()  # an owner is a row here, a null one too
    most = max(1, min(max_owners, known - 1))
    each = scanned.select("id", "text_hash", "owner", "repository", F.explode("found").alias("f")).select("id", "text_hash", "owner", "repository", "f.*")
    counts = cut(ownership(each.select("value", "owner", "repository")))
    judged = each.join(counts.withColumnRenamed("value", "v"), F.col("value") == F.col("v")).select(
        "id", "text_hash", "kind", "a", "b", "owners", "repositories", ((F.col("owners") <= most) & (F.col("repositories") <= max_repositories)).alias("owned")
    )
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    keep = (F.col("kind") < len(SECRET_KINDS)) | F.col("owned")
    span = F.concat_ws(":", name, F.col("a").cast("string"), F.col("b").cast("string"))
    # One set of all values found, in order; what is kept, and the counts, are read from it.
    found = F.sort_array(F.collect_set(F.struct("a", "kind", span.alias("s"), keep.alias("keep"), "owned", "owners", "repositories")))
    per_doc = cut(judged.groupBy("id", "text_hash").agg(found.alias("f")))
    p = per_doc.select(F.col("id").alias("p_id"), F.col("text_hash").alias("p_hash"), "f")
    joined = scanned.join(p, F.col("id").eqNullSafe(F.col("p_id")) & F.col("text_hash").eqNullSafe(F.col("p_hash")), "left")
    f = F.coalesce("f", F.array().cast(p.schema["f"].dataType))
    return joined.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(F.filter(f, lambda x: x["keep"]), lambda x: x["s"]), ",").alias("spans"),
        F.size(F.filter(f, lambda x: x["owned"])).cast("long").alias("n_owned"),
        F.size(F.filter(f, lambda x: ~x["owned"])).cast("long").alias("n_shared"),
        F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["s"], x["owners"].cast("string"), x["repositories"].cast("string"))), ",").alias("ownership"),
    )


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
