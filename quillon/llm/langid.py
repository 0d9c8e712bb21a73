"""Language by Bayesian fusion: the text's likelihood, the declared language, the address, and the host's prior."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import LOWER, as_bytes, mapped, materialize, prepare, schema, sliced, trim

#: Distinct texts a language to fit on, hash bits of byte trigrams, text bytes handled at a time.
FIT_DOCS, BITS, PART = 400, 16, 1 << 20
#: Pseudo-counts: of a trigram, of the global prior in a site's, and of the site's in a host's.
SMOOTH, SITE, HOST = 0.1, 50.0, 20.0
#: Trigrams beyond which a text's evidence no longer grows: they are far from independent.
EVIDENCE = 200
#: Trust in a declared language and in an address; least posterior of a language that is kept.
DECLARED, ADDRESS, LEAST = 0.9, 0.8, 0.5
#: Bytes up to which the hosts' priors are broadcast; hosts a task sums up at a time.
BROADCAST, HOSTS = 4 << 20, 50_000
#: Posteriors are summed as whole numbers of this many parts, so that sums don't depend on their order.
PARTS = 1 << 20
#: Endings of countries, whose language has another code.
COUNTRY = {"at": "de", "li": "de", "mx": "es", "ar": "es", "cl": "es", "pe": "es", "ve": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "br": "pt", "jp": "ja", "cn": "zh", "tw": "zh", "kr": "ko", "ua": "uk", "se": "sv", "dk": "da", "cz": "cs", "gr": "el", "ir": "fa", "il": "he", "vn": "vi", "rs": "sr", "ee": "et", "si": "sl", "by": "be", "am": "hy", "al": "sq", "in": "hi", "my": "ms"}


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashes of the byte trigrams that start at each of raw[:-2], case folded; those without a letter are -1."""
    low = LOWER[raw]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, 32).astype(np.uint32)  # all else counts as one gap
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    hashed = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    return np.where(letter[:-2] | letter[1:-1] | letter[2:], hashed, -1)


def folded(label: Column) -> Column:
    """The language of a label: its first subtag in lower case, or null if that is no code of two or three letters."""
    first = F.lower(F.regexp_extract(label.cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(first != "", first)


def markup_language(html: Column) -> Column:
    """The language that a page's markup declares: lang or xml:lang of its html element, else its content-language."""
    own = F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([A-Za-z][\w-]*)", 1)
    xml = F.regexp_extract(html, r"(?is)<html\b[^>]*?\sxml:lang\s*=\s*[\"']?\s*([A-Za-z][\w-]*)", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*?content-language[\"']?[^>]*?\scontent\s*=\s*[\"']?\s*([A-Za-z][\w-]*)", 1)
    return F.coalesce(*(F.when(x != "", x) for x in (own, xml, meta)))


def fit(docs: DataFrame, text: str = "text", declared: str = "lang", fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and a table of log likelihoods (trigram x language), from at most fit_docs texts a language.

    Of each language's distinct texts those with the smallest hashes are taken whole, so the sample does not
    depend on the layout of the data or on copies. Languages are all well-formed declared ones, the most frequent
    first; without any, the model is empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    some = docs.select(folded(F.col(declared)).alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    # well-formed codes bound the languages
    counts = some.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("rows"), "lang").collect()
    langs = [r.lang for r in counts]
    if not langs:
        return [], np.zeros((1 << BITS, 0), dtype=np.float32)
    # only hashes so small that a few times fit_docs texts have them are dealt out at all
    least = spark.createDataFrame(pa.table({"lang": langs, "least": [int(min(1.0, 4 * fit_docs / max(r.texts, 1)) * (1 << 31)) for r in counts]}))
    rank = F.shiftrightunsigned("h", 33)
    few = some.join(F.broadcast(least), "lang").where(rank < F.col("least")).dropDuplicates(["lang", "h"])
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(rank, "h"))).where(F.col("rank") <= fit_docs).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = trigrams(np.frombuffer(t.as_py().encode(), dtype=np.uint8))
                seen[lang] = seen.get(lang, 0) + np.bincount(found[found >= 0], minlength=1 << BITS).astype(np.int32)
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": [*seen], "counts": pa.array([x.tobytes() for x in seen.values()], pa.binary())})
        trim()

    # the window has brought each language to one task, so a language is one row here
    table = np.full((1 << BITS, len(langs)), SMOOTH)
    for r in few.mapInArrow(count, "lang string, counts binary").collect():
        table[:, langs.index(r.lang)] += np.frombuffer(r.counts, dtype=np.int32)
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def address_language(url: str | None, langs: list[str]) -> str | None:
    """The language an address points to: a path segment, a subdomain, or the domain's ending."""
    found = re.match(r"(?:\w+:)?//([^/?#]*)([^?#]*)", url or "")
    if not found:
        return None
    host, path = found[1].lower().split("@")[-1].split(":")[0].split("."), found[2].lower().split("/")
    for x in (*path, *host[:-1][:1]):
        if (x := re.split(r"[-_]", x)[0]) in langs:
            return x
    ending = COUNTRY.get(host[-1], host[-1])
    return ending if ending in langs else None


def likelihoods(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log likelihood of each text raw[at[k]:at[k+1]] in each language, and its trigrams."""
    rows, n = len(at) - 1, table.shape[1]
    sums, count = np.zeros((rows, n)), np.zeros(rows, dtype=np.int64)
    if len(raw) > 2 and n:
        found = trigrams(raw)
        row = np.repeat(np.arange(rows), np.diff(at))[: len(found)]
        inside = (found >= 0) & (np.arange(len(found)) + 3 <= at[1:][row])
        found, row = found[inside], row[inside]
        count = np.bincount(row, minlength=rows)
        for k in range(n):
            sums[:, k] = np.bincount(row, weights=table[:, k][found], minlength=rows)
    return sums * (EVIDENCE / np.maximum(count, EVIDENCE))[:, None], count


def _masses(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(host, m0, m1, ...): the posteriors of the texts alone, in PARTS, summed by host."""
    n = table.shape[1]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), *(pa.array([int(x[k]) for x in held.values()], pa.int64()) for k in range(n))], names=["host", *(f"m{k}" for k in range(n))])
            held.clear()
            return out

        for batch in batches:
            for start, end in sliced(batch.column(1), PART):
                sums, count = likelihoods(*as_bytes(batch.column(1).slice(start, end - start)), table)
                own = np.exp(sums - sums.max(axis=1, keepdims=True))
                whole = np.rint(own / own.sum(axis=1, keepdims=True) * PARTS).astype(np.int64) * (count > 0)[:, None]
                for h, x in zip(batch.column(0).slice(start, end - start).to_pylist(), whole, strict=True):
                    held[h] = held.get(h, 0) + x
                if len(held) > HOSTS:
                    yield flush()
        if held:
            yield flush()
        trim()

    parts = rows.select("host", "text").mapInArrow(over, ", ".join(["host string", *(f"m{k} bigint" for k in range(n))]))
    return parts.groupBy("host").agg(*(F.sum(f"m{k}").alias(f"m{k}") for k in range(n)))


def identify(
    docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", url: str | None = None,
    model: tuple[list[str], np.ndarray] | None = None, carry: list[str] | None = None, least: float = LEAST,
) -> DataFrame:
    """Every row's carried columns with language, confidence, text_language, n_trigrams and kept.

    posterior(l) ~ P(text | l)^t * P(declared | l) * P(address | l) * P(l | host), where t tempers long texts to
    the weight of EVIDENCE trigrams. P(l | host) is smoothed by its site's (the last two labels of the host's
    name), and that by the whole table's; all three are sums of the posteriors of the texts alone. Absent
    evidence counts for nothing. A row is kept if its text has a letter and its best posterior is `least` or
    more; a null or empty text, or one without letters, gets language "und" and goes. Rows are judged one by
    one, ties go to the more frequent language. Columns of docs with the names of the results are replaced.

    Texts are read twice and never written: once for the hosts' sums, once to be judged.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = ["language", "confidence", "text_language", "n_trigrams", "kept"]
    langs, table = model or fit(docs, text, declared)
    n = len(langs)
    cols = [x for x in (carry if carry is not None else docs.columns) if x not in names]
    host_of = F.col(host).cast("string") if host else F.lower(F.regexp_extract(F.col(url), r"^(?:\w+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)) if url else F.lit(None).cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{x}`") for x in cols if x != text), F.lit(0).alias("none")).alias("row"), F.col(text).cast("string").alias("text"),
        (folded(F.col(declared)) if declared else F.lit(None).cast("string")).alias("declared"),
        (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"), F.when(host_of != "", host_of).alias("host"),
    )
    fixed = ["row", "text"] if text in cols else ["row"]

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        get = lambda x: part.column(part.schema.get_field_index(x))
        sums, count = likelihoods(*as_bytes(get("text")), table)
        address = [address_language(u, langs) for u in get("url").to_pylist()]
        logs = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([*map(get, (*fixed, "declared", "host")), pa.array(address, pa.string()), pa.array(count, pa.int64()), logs], names=[*fixed, "declared", "host", "address", "n_trigrams", "logs"])

    scored = mapped(rows, judge, schema([rows.schema[x] for x in fixed], "declared string, host string, address string, n_trigrams bigint, logs array<double>"), "text", PART)
    if n:
        masses = materialize(_masses(rows, table), "langid-hosts")
        sums = F.array(*(F.col(f"m{k}") / PARTS for k in range(n)))
        everywhere = masses.agg(*(F.sum(f"m{k}") for k in range(n))).first()
        whole = sum(x or 0 for x in everywhere) / PARTS
        prior = F.array(*(F.lit(((x or 0) / PARTS + 1) / (whole + n)) for x in everywhere))
        smooth = lambda counts, base, weight: F.expr(f"transform({counts}, (x, i) -> (x + {weight}D * {base}[i]) / (aggregate({counts}, 0D, (a, b) -> a + b) + {weight}D))")
        per_host = masses.where("host is not null").withColumn("site", F.substring_index("host", ".", -2))
        per_site = per_host.groupBy("site").agg(*(F.sum(f"m{k}").alias(f"m{k}") for k in range(n))).select("site", sums.alias("s"))
        hosts = per_host.select("host", "site", sums.alias("h")).join(per_site, "site").withColumn("g", prior)
        hosts = hosts.withColumn("sp", smooth("s", "g", SITE)).withColumn("hp", smooth("h", "sp", HOST)).select("host", "hp")
        if masses.count() * (8 * n + 100) <= BROADCAST:
            scored = scored.join(F.broadcast(hosts), "host", "left")
        else:
            # rows without a host would all meet in one task of an outer join
            hosts = materialize(hosts, "langid-priors")
            scored = scored.where("host is not null").join(hosts, "host", "left").unionByName(scored.where("host is null").withColumn("hp", F.lit(None).cast("array<double>")))
        scored = scored.withColumn("prior", F.coalesce("hp", prior))
    else:
        scored = scored.withColumn("prior", F.array().cast("array<double>"))
    vote = lambda column, trust: f"if(array_contains(langs, {column}), if(langs[i] = {column}, {log(trust)}D, {log((1 - trust) / max(n - 1, 1))}D), 0D)"
    scored = scored.withColumn("langs", F.array(*map(F.lit, langs)).cast("array<string>")).withColumn("post", F.expr(f"transform(logs, (x, i) -> x + ln(prior[i]) + {vote('declared', DECLARED)} + {vote('address', ADDRESS)})"))
    scored = scored.withColumn("best", F.expr("array_position(post, array_max(post))").cast("int"))
    scored = scored.withColumn("confidence", F.expr("1D / aggregate(post, 0D, (a, x) -> a + exp(x - array_max(post)))"))
    sure = (F.col("n_trigrams") > 0) & (F.size("post") > 0)
    out = scored.select(
        *(F.col("text" if x == text else f"row.`{x}`").alias(x) for x in cols),
        F.when(sure, F.expr("try_element_at(langs, best)")).otherwise("und").alias("language"),
        F.when(sure, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(sure, F.expr("try_element_at(langs, cast(array_position(logs, array_max(logs)) as int))")).otherwise("und").alias("text_language"), "n_trigrams",
    )
    return out.withColumn("kept", (F.col("language") != "und") & (F.col("confidence") >= least))
