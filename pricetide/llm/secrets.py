"""Secret scan with ownership counts: how many repositories and owners hold a candidate tells examples from live ones."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import stored

# Kinds of candidates in their order, and their patterns. Letters of a keyword count in either case.
KINDS = ("assign", "access", "hex", "key")
_KEYWORD = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(
    "(?:" + re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", _KEYWORD) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # runs are maximal, so a shorter one holds no longer one
HEX = re.compile("[0-9a-f]{24,}")
KEY = re.compile("[A-Za-z0-9+/_=-]{20,}")

# A token outside the base patterns is a candidate if it mixes letters and digits and its characters vary enough.
LEAST_ENTROPY = 3.5
# From so many owners on a value is taken for a widely copied example; between two owners, and this number, from so many
# repositories on. One owner may have it in any number of repositories.
MANY_OWNERS, MANY_REPOSITORIES = 3, 6

# Values leave a task as digests only.
FOUND = "array<struct<kind:int,start:int,end:int,digest:string>>"


def entropy(token: str) -> float:
    return -sum(c / len(token) * math.log2(c / len(token)) for c in map(token.count, set(token)))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind: base matches, and tokens that look like keys where no base match is."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in out)
    at = 0
    for m in KEY.finditer(text):
        token = m[0]
        if token.isalpha() or token.isdigit() or not (any(map(str.isdigit, token)) and any(map(str.isalpha, token))):
            continue
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        if (at == len(base) or base[at][0] >= m.end()) and entropy(token) >= LEAST_ENTROPY:
            out.append((3, m.start(), m.end(), token))
    return sorted(out, key=lambda c: (c[1], c[0]))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(doc_id, owner, repository, found) of every row, `found` as given by `candidates`; a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                [{"kind": k, "start": s, "end": e, "digest": hashlib.sha256(v.encode()).hexdigest()} for k, s, e, v in candidates(t)]
                for t in pdf.text
            ]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "owner": pdf.owner, "repository": pdf.repository, "found": found})

    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(run, f"doc_id string, owner string, repository string, found {FOUND}")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_repositories, n_owners) over the corpus; a null owner or repository counts as one of its own.

    Distinct (digest, repository, owner) come first, which tasks combine before the shuffle: a value that a third of
    all documents holds leaves each task once per repository.
    """
    each = found.select(F.explode("found.digest").alias("digest"), "owner", "repository").fillna("", ["owner", "repository"]).distinct()
    owners = each.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("digest").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def find_secrets(
    docs: DataFrame, owner: Column, repository: Column, many_owners: int = MANY_OWNERS, many_repositories: int = MANY_REPOSITORIES
) -> DataFrame:
    """One row per row of `docs`: doc_id, base and all spans, and what the ownership of its values says.

    Base spans are always reported. A key-like token is reported only if its value is not widely copied: `many_owners`
    owners have it, or two or more have it in `many_repositories` repositories. `n_live` and `n_copied` count the candidates of either sort. Repeated rows give repeated results; a null
    text or a text without candidates gives empty lists.
    """
    held = stored(scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    one = held.select("row", F.explode("found").alias("c")).select("row", "c.*")
    wide = (F.col("n_owners") >= many_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repositories") >= many_repositories))
    copied = ownership(held).filter(wide).select("digest", "n_owners")
    marked = one.join(copied, "digest", "left").select(
        "row", F.struct("start", "kind", "end", F.coalesce("n_owners", F.lit(0)).alias("n_owners")).alias("c"))
    spans = marked.groupBy("row").agg(F.sort_array(F.collect_list("c")).alias("spans"))
    rows = held.select("row", "doc_id").join(spans, "row", "left")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,n_owners:bigint>>")
    spans = F.coalesce("spans", none)
    base = F.filter(spans, lambda c: c.kind < 3)
    every = F.filter(spans, lambda c: (c.kind < 3) | (c.n_owners == 0))
    return rows.select(
        "doc_id", base.alias("base"), every.alias("every"),
        F.size(F.filter(spans, lambda c: c.n_owners == 0)).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda c: c.n_owners > 0)).cast("long").alias("n_copied"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c.kind + 1), c.start, c.end)), ",")
