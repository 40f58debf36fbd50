"""Language identification by Bayesian evidence fusion.

log P(lang | all) = log P(text | lang) + log P(declared markup language | lang)
+ log P(address suffix | lang) + log P(lang | host) + constant.

* Text: character n-gram naive Bayes, summed over the distinct words of a batch;
  the evidence of a text is tempered (its n-grams overlap).
* Declared language (<html lang=...>) and address suffix (a path segment, or the
  host's top-level domain): confusion tables estimated by grouped aggregation of
  what is declared against what the text says, with additive smoothing.
* Host prior: counts by host are smoothed towards their parent domain, and those
  towards the whole table (two Dirichlet steps), all by grouped aggregation.

Only the n-gram table is fitted on the driver, on a bounded sample of labelled
texts; everything else covers all rows.

Defined results: null, empty and letterless texts have no text evidence; with no
other evidence they get lang 'und' and are rejected, as is any row whose best
posterior is under the threshold. A text with more than UNKNOWN_SHARE of n-grams
that no labelled language has is in none of them: it gets 'und', posterior 0, is
rejected whatever its markup or host says, and counts for no prior. A text in
several languages gets that of most of its words. A null host, address or markup
gives no evidence. Repeated rows are judged each; an empty table gives no rows. Of
training rows with one id and label, one counts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window

from ._common import F, T, fresh, map_batches, segment_sum, stored, strings

#: Labelled texts of each language that fitting reads at most, and their bytes.
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES = 1_000, 32 << 20
#: Labels that are modelled at most: the most frequent ones. Rows of others are
#: judged like any row, but there is no model of their language.
MOST_LABELS = 200
GRAMS = (1, 2, 3)
#: Text bytes handled at once: a word takes a row of numbers for all languages.
SLICE = 2 << 20
#: Share of the summed n-gram evidence that counts: n-grams overlap.
TEMPER = 0.25
LETTERS = re.compile(r"[^\W\d_]")
DIGIT = re.compile(r"\d")
HOST_STRENGTH, DOMAIN_STRENGTH = 5.0, 20.0

#: Least posterior of the best language: what is hardly better than chance is rejected.
THRESHOLD = 0.3
#: Largest share of unknown n-grams in a text of a known language. The posterior
#: only compares languages; this judges the fit by itself. Words with digits (keys,
#: codes) are in no language and don't count here.
UNKNOWN_SHARE = 0.15


@dataclass
class NgramModel:
    langs: list[str]
    table: dict[str, int]  # n-gram -> row of logp; row 0: any other
    logp: np.ndarray  # (rows, langs)

    def word(self, word: str) -> list[int]:
        """Rows of the word's n-grams; none without letters."""
        core = "".join(LETTERS.findall(word.lower()))
        if not core:
            return []
        w = f"<{core}>"
        get = self.table.get
        return [get(w[i : i + n], 0) for n in GRAMS for i in range(len(w) - n + 1)]


def fit_ngrams(rows: list[tuple[str, str]], least: int = 3) -> NgramModel:
    """rows: (text, lang)."""
    words: dict[str, Counter] = {}
    for text, lang in rows:
        words.setdefault(lang, Counter()).update(text.lower().split())
    counts: dict[str, Counter] = {}
    for lang, seen in words.items():
        cores: Counter = Counter()
        for word, k in seen.items():
            core = "".join(LETTERS.findall(word))
            if core:
                cores[core] += k
        own = counts[lang] = Counter()
        for core, k in cores.items():
            w = f"<{core}>"
            for n in GRAMS:
                for i in range(len(w) - n + 1):
                    own[w[i : i + n]] += k
    langs = sorted(counts)
    total = Counter()
    for c in counts.values():
        total.update(c)
    names = sorted(g for g, k in total.items() if k >= least)
    table = {g: i + 1 for i, g in enumerate(names)}
    logp = np.zeros((len(names) + 1, len(langs)))
    for j, lang in enumerate(langs):
        c = counts[lang]
        n = sum(c.values()) + len(names) + 1
        logp[1:, j] = [np.log((c[g] + 1) / n) for g in names]
        logp[0, j] = np.log(1 / n)
    return NgramModel(langs, table, logp)


class TextEvidence:
    LIMIT = 300_000

    def __init__(self, model: NgramModel):
        self.model = model
        self._start()

    def _start(self):
        self.code: dict[str, int] = {}
        self.value = np.zeros((0, len(self.model.langs)))
        self.grams = np.zeros((0, 3), np.int64)

    def of(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(tempered log likelihoods by language, null if the text is in none of them;
        words with letters)."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets -= offsets[0]
        if len(self.code) > self.LIMIT:
            self._start()
        coded = values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.code]
        values = [self.value]
        counts = [self.grams]  # n-grams; those judged, and those of them unknown
        for block in range(0, len(new), 8192):  # bounds the n-grams that are held at once
            grams = [self.model.word(w) for w in new[block : block + 8192]]
            size = np.fromiter(map(len, grams), np.int64, len(grams))
            flat = np.fromiter((g for own in grams for g in own), np.int64, int(size.sum()))
            owner = np.repeat(np.arange(len(grams)), size)
            values.append(np.stack([np.bincount(owner, self.model.logp[flat, k], len(grams)) for k in range(len(self.model.langs))], axis=1))
            plain = np.fromiter((not DIGIT.search(w) for w in new[block : block + 8192]), np.int64, len(grams))
            counts.append(np.stack([size, plain * size, plain * np.bincount(owner, flat == 0, len(grams)).astype(np.int64)], axis=1))
        if new:
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
            self.value, self.grams = np.concatenate(values), np.concatenate(counts)
        codes = np.fromiter((self.code[w] for w in distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        sums = np.stack([np.bincount(owner, self.value[codes, k], len(texts)) for k in range(len(self.model.langs))], axis=1)
        size, unknown = (segment_sum(self.grams[codes, k], offsets) for k in (1, 2))
        foreign = bool(self.model.table) & (unknown > UNKNOWN_SHARE * size)
        ll = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(TEMPER * sums.reshape(-1)), mask=pa.array(foreign))
        return ll, pa.array(segment_sum(self.grams[codes, 0] > 0, offsets).astype(np.int64))


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES, most_labels: int = MOST_LABELS) -> NgramModel:
    """Sample: for each of the most frequent labels, rows in the order of a hash of
    their ids, up to per_language of them and sample_bytes (the first counts always)."""
    i, lang, text = F.col(id_col).cast("long").alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(i, lang, F.octet_length(text).alias("size"))
    counts = known.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_labels)
    # of a frequent label only the low end of the hashes is ranked
    h = F.xxhash64("i")
    low = known.join(F.broadcast(counts), "l").where((h / F.lit(2.0**64) + 0.5) * F.col("n") <= 2 * per_language + 50)
    order = Window.partitionBy("l").orderBy(h, "i", "size")
    ranked = low.withColumn("rank", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    picks = ranked.where((F.col("rank") <= per_language) & ((F.col("upto") <= sample_bytes) | (F.col("rank") == 1))).select("i", "l").distinct()
    # at most per_language ids of each of most_labels labels
    rows = docs.select(i, lang, text).join(F.broadcast(picks), ["i", "l"]).groupBy("i", "l").agg(F.min_by("t", F.xxhash64("t")).alias("t")).orderBy("i", "l").collect()
    if not rows:
        return NgramModel(["und"], {}, np.zeros((1, 1)))
    return fit_ngrams([(r["t"], r["l"]) for r in rows])


def markup_language(html: Column) -> Column:
    """The primary tag of <html lang=...>, lower-cased; null if none."""
    tag = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", 1))
    return F.when(tag != "", tag)


def address_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def address_suffix(url: Column) -> Column:
    """A two-letter first path segment, else the host's top-level domain."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    top = F.regexp_extract(address_host(url), r"\.([a-z]{2,})$", 1)
    return F.when(path != "", path).when(top != "", top)


def parent_domain(host: Column) -> Column:
    """The last two labels of a host; a host of one label is its own parent."""
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def html_text(html: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.regexp_replace(out, r"&[a-zA-Z]+;|&#\d+;", " ")


def text_evidence(rows: DataFrame, model: NgramModel, text: Column, keep: dict[str, Column]) -> DataFrame:
    """keep's columns, `ll` (array of log likelihoods; null: no known language) and `evidence` (words)."""
    narrow = rows.select(*(c.alias(n) for n, c in keep.items()), text.cast("string").alias("_text_in"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("evidence", T.LongType())])
    held: list[TextEvidence] = []

    def run(batch):
        if not held:
            held.append(TextEvidence(model))
        ll, words = held[0].of(strings(batch.column(batch.num_columns - 1)))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], ll, words], names=schema.names)

    return map_batches(narrow, schema, run, SLICE)


def _posterior(logs: Column) -> Column:
    """Normalised exp of an array of log weights."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(n: int, name: str) -> list[Column]:
    return [F.sum(F.col(name)[k]).alias(f"s{k}") for k in range(n)]


def priors(ev: DataFrame, langs: list[str]) -> dict[str, DataFrame]:
    """Small tables by grouped aggregation of the rows with text evidence (columns
    host, declared, suffix, ll, evidence): smoothed log priors by host, and log
    likelihoods of each declared tag and suffix."""
    n = len(langs)
    soft = ev.where("evidence > 0 and ll is not null").withColumn("p", _posterior(F.col("ll"))).withColumn("domain", parent_domain(F.col("host")))
    by = soft.groupBy("domain", "host", "declared", "suffix").agg(*_sums(n, "p"))
    by = stored(by, "evidence-counts")
    arr = F.array(*(F.col(f"s{k}") for k in range(n)))

    def grouped(*keys):
        return by.groupBy(*keys).agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(n)))

    total = grouped().first()
    mass = [float(total[f"s{k}"] or 0.0) if total else 0.0 for k in range(n)]
    whole = [(m + 1.0) / (sum(mass) + n) for m in mass]

    def smoothed(counts, strength, base):
        size = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, base, lambda c, b: (c + strength * b) / (size + strength))

    base = F.array(*(F.lit(w) for w in whole))
    domains = grouped("domain").where("domain is not null").select("domain", smoothed(arr, DOMAIN_STRENGTH, base).alias("domain_prior"))
    hosts = grouped("domain", "host").where("host is not null").select("domain", "host", arr.alias("c"))
    hosts = hosts.join(domains, "domain").select("host", F.transform(smoothed(F.col("c"), HOST_STRENGTH, F.col("domain_prior")), lambda x: F.log(x)).alias("log_prior"))
    out = {"host": stored(hosts, "host-priors")}
    for name in ("declared", "suffix"):
        t = grouped(name).where(F.col(name).isNotNull())
        # P(tag | lang), with one imagined row of each language
        out[name] = stored(t.select(name, F.transform(F.zip_with(arr, F.array(*(F.lit(m + 1.0) for m in mass)), lambda c, m: (c + 0.05) / m), lambda x: F.log(x)).alias(f"log_{name}")), f"{name}-table")
    out["whole"] = whole
    return out


def fuse(ev: DataFrame, tables: dict, langs: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """ev's columns with lang, posterior and accepted."""
    n = len(langs)
    zero = F.array(*(F.lit(0.0) for _ in range(n)))
    out = ev
    for name, value in (("host", "log_prior"), ("declared", "log_declared"), ("suffix", "log_suffix")):
        # Spark broadcasts these only below its own size limit
        out = out.join(tables[name], name, "left")
    default = F.array(*(F.lit(float(np.log(w))) for w in tables["whole"]))
    logs = F.coalesce("log_prior", default)
    for c in (F.when(F.col("evidence") > 0, F.col("ll")), F.col("log_declared"), F.col("log_suffix")):
        logs = F.zip_with(logs, F.coalesce(c, zero), lambda a, b: a + b)
    out = out.withColumn("_post", _posterior(logs))
    best = F.array_max("_post")
    known = F.col("ll").isNotNull() & ((F.col("evidence") > 0) | F.col("log_declared").isNotNull())
    lang = F.array(*(F.lit(x) for x in langs))[F.array_position("_post", best).cast("int") - 1]
    out = out.withColumn("lang", F.when(known, lang).otherwise(F.lit("und"))).withColumn("posterior", F.when(known, best).otherwise(F.lit(0.0)))
    out = out.withColumn("accepted", known & (F.col("posterior") >= threshold))
    return out.select(*[c for c in ev.columns if c not in ("ll", "lang")], "lang", "posterior", "accepted")


def document_evidence(docs: DataFrame, host_col: str, url_col: str, html_col: str) -> dict[str, Column]:
    """Host, declared language and suffix of documents, from the columns they have."""
    null = F.lit(None).cast("string")
    url = F.col(url_col).cast("string") if url_col in docs.columns else None
    host = F.col(host_col).cast("string") if host_col in docs.columns else null
    return {
        "host": host if url is None else F.coalesce(address_host(url), host),
        "declared": markup_language(F.col(html_col).cast("string")) if html_col in docs.columns else null,
        "suffix": null if url is None else address_suffix(url),
    }


def identify_documents(docs: DataFrame, model: NgramModel, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """doc_id, host, evidence, lang, posterior, accepted. Addresses and markup are
    evidence where docs has such columns."""
    ev = text_evidence(docs, model, F.col(text_col), {"doc_id": F.col(id_col).cast("long"), **document_evidence(docs, host_col, url_col, html_col)})
    ev = stored(ev, "text-evidence")
    return fuse(ev, priors(ev, model.langs), model.langs).select("doc_id", "host", "evidence", "lang", "posterior", "accepted")


def identify_pages(pages: DataFrame, model: NgramModel, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, declared, suffix, evidence, lang, posterior, accepted."""
    url, html = F.col(url_col), F.col(html_col)
    keep = {"page_id": F.col(id_col).cast("long"), "host": address_host(url), "declared": markup_language(html), "suffix": address_suffix(url)}
    ev = stored(text_evidence(pages, model, html_text(html), keep), "text-evidence")
    return fuse(ev, priors(ev, model.langs), model.langs).select("page_id", "host", "declared", "suffix", "evidence", "lang", "posterior", "accepted")


def accepted_documents(docs: DataFrame, model: NgramModel, *, text_col: str = "text", host_col: str = "source", url_col: str = "url", html_col: str = "html", lang_col: str = "lang", wanted: list[str] | None = None) -> DataFrame:
    """docs without the rows that identification rejects, and with the language that
    it found in lang_col, if docs has that column.

    wanted: languages to keep, all if None. The texts are read once: rows and their
    evidence are written, as the host priors need all rows before any is judged.
    """
    names = fresh(docs, "_ll", "_evidence")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.DoubleType())), T.StructField(names[1], T.LongType())])
    held: list[TextEvidence] = []

    def run(batch):
        if not held:
            held.append(TextEvidence(model))
        ll, words = held[0].of(strings(batch.column(at)))
        return pa.RecordBatch.from_arrays([*batch.columns, ll, words], names=schema.names)

    scored = stored(map_batches(docs, schema, run, SLICE), "language-evidence")
    own = [F.col(names[0]).alias("ll"), F.col(names[1]).alias("evidence"), *(c.alias(n) for n, c in document_evidence(docs, host_col, url_col, html_col).items())]
    tables = priors(scored.select(*own), model.langs)
    judged = fuse(scored.select(F.struct(*docs.columns).alias("_row"), *own), tables, model.langs).where("accepted")
    if wanted is not None:
        judged = judged.where(F.col("lang").isin(wanted))
    return judged.select(*(F.col("lang").cast(docs.schema[c].dataType).alias(c) if c == lang_col else F.col("_row")[c].alias(c) for c in docs.columns))
