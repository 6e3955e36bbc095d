"""Personal data by patterns and information-theoretic sanitisation, with DataFrame functions only: op4.

Base spans come from four patterns. The method adds the terms that give an entity away: over all documents, how often an entity
(the matched string) and a term, which is any word or number, stand in one document is compared with how often either occurs,

    disclosure(e, t) = log(n(e, t) * N / (n(e) * n(t))) / log(N / n(e)),

the pointwise mutual information as a share of the entity's information content; 1 means that the term is found with the
entity only. Terms at or over the threshold are spans of kind `term` wherever they stand in a text with that entity. Every pair is judged, also
those of one text only; `least_texts` asks for more texts. sanitise() puts [KIND] in place of spans, which generalises entities and removes terms.

Few pairs are made, however many mentions a text has. As n(e, t) is 1 at least, a term that is rare enough for the rarest entity of its text is
told without any; as it is n(e) and n(t) at most, one that is too frequent for the most frequent entity is not. Only between the two is
n(e, t) counted, of entities that the same bound admits, and entities that stand in the same documents are one. Within a text all sums
run over pieces, so time grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, stored, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Possessive repeats and the conditions before the first character keep the matches and make long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Every word or number is a term.
TOKEN = r"[\p{L}\p{M}\p{N}]+"
PIECE = 64
THRESHOLD = 0.85
#: Different texts in which entity and term must stand together.
LEAST_TEXTS = 1
#: Code points of a text that are cleaned together.
CHUNK = 8192


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once: it stands as a lambda's variable in what `use` makes."""
    return F.transform(F.array(value), use)[0]


def _pieces(items: Column) -> Column:
    return _bound(items, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(PIECE)), lambda i: F.slice(x, i, F.lit(PIECE))))


def _before(pieces: Column, of, start: Column, merge) -> Column:
    """For each piece what merge() makes of start and of(piece) of all pieces before it. Arrays that grow are of numbers, one for each piece."""
    step = lambda acc, p: F.struct(merge(acc["at"], of(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(pieces, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def _placed(parts: Column, word: str) -> Column:
    """From (gap, size, word) in turn pieces of (start, end, word): the word starts where the one before ends and the gap after it."""
    kind = f"array<struct<start:int,end:int,{word}:string>>"
    long = lambda piece: F.aggregate(piece, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["word"].alias(word)))).alias("out"))

    each = lambda p, at: F.aggregate(p, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    return _bound(_pieces(parts), lambda ps: F.zip_with(ps, _before(ps, long, F.lit(0), lambda at, n: at + n), each))


def _matches(text: Column, pattern: str, say) -> Column:
    """(gap, size, word) of leftmost non-overlapping matches. Starts follow from the lengths of what split() leaves between matches, as both
    functions find the same matches."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, word: F.struct(F.length(gap).alias("gap"), F.length(word).alias("size"), say(word).alias("word")))
    return F.filter(parts, lambda x: x["word"].isNotNull())


def located(text: Column, pattern: str) -> Column:
    """Matches with code points: array of (start, end, word)."""
    return F.flatten(_placed(_matches(text, pattern, lambda word: word), "word"))


def luhn(word: Column) -> Column:
    """12 to 19 digits whose Luhn sum is divisible by ten."""
    digits = F.reverse(F.regexp_replace(word, "[^0-9]", ""))
    size = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.when(size.between(12, 19), F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), add) % 10 == 0).otherwise(False)


def valid(kind: str, word: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return word.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return luhn(word)
    if kind == "phone":
        return F.length(F.regexp_replace(word, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of (start, rank, end, kind, word) in order of start, then kind."""
    # what a text must hold for a kind to occur; spares the patterns on most texts
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,word:string>>")

    def of(rank: int, kind: str) -> Column:
        good = F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x["word"]))
        full = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["word"].alias("word")))
        return F.when(needs[kind], full).otherwise(none)

    every = [of(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*every))


def tokens(text: Column) -> Column:
    """Pieces of all words and numbers with code points, (start, end, term), terms in lower case."""
    return _placed(_matches(text, TOKEN, F.lower), "term")


def free_tokens(text: Column, base: Column) -> Column:
    """The tokens that no base span touches. A piece of tokens is held against the spans that reach into it."""
    runs = F.transform(_pieces(base), lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(p, lambda b: b["end"])).alias("hi"), p.alias("spans")))

    def free(words: Column, runs: Column) -> Column:
        lo, hi = F.get(words, F.lit(0))["start"], F.get(words, F.size(words) - 1)["end"]
        some = F.flatten(F.transform(F.filter(runs, lambda r: (r["lo"] < hi) & (r["hi"] > lo)), lambda r: F.filter(r["spans"], lambda b: (b["start"] < hi) & (b["end"] > lo))))
        return _bound(some, lambda near: F.filter(words, lambda w: ~F.exists(near, lambda b: (w["start"] < b["end"]) & (w["end"] > b["start"]))))

    return F.flatten(_bound(runs, lambda r: F.transform(tokens(text), lambda p: free(p, r))))


def find_spans(df: DataFrame, key: str, text: str = "text", threshold: float = THRESHOLD, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(_kd, _kt, key, base, spans) for every row of df: base spans, and all spans with those of kind `term`.

    A null text is empty and has no spans, and so has an empty one; texts of any length are taken whole. Rows that are equal in key
    and text have equal spans and count as documents of their own in every total (documents, n_e, n_t, n_et). Terms are never taken
    out of base spans. A corpus without entities, or where none stands in `least_texts` different texts, has base spans only; an
    empty table gives no rows. Other columns of df are not looked at.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.xxhash64(F.lit(1), key).alias("_kd"), F.xxhash64(body).alias("_kt"), F.col(key).alias("_key"), body.alias("_text")).withColumn("base", base_spans(F.col("_text")))
    first = slim = stored(rows.select("_kd", "_kt", "_key", "base", F.when(F.size("base") > 0, F.col("_text")).alias("_text")), "pii-spans")

    held = slim.filter(F.size("base") > 0).groupBy("_kd", "_kt").agg(F.count("*").alias("copies"), F.first("base").alias("base"), F.first("_text").alias("_text"))
    words = held.select("_kd", "_kt", "copies", F.explode(free_tokens(F.col("_text"), F.col("base"))).alias("w")).select("_kd", "_kt", "copies", "w.start", "w.end", "w.term")
    words = stored(words, "pii-terms")
    entity = F.transform("base", lambda b: F.concat_ws(":", b["kind"], F.lower(b["word"])))
    seen = stored(held.select("_kd", "_kt", "copies", F.explode(F.array_distinct(entity)).alias("entity")), "pii-entities")
    told = _telling(df.select(body.alias("_text")), seen, words.groupBy("_kd", "_kt", "term").agg(F.first("copies").alias("copies")), float(max(2, slim.count())), threshold, least_texts)
    extra = words.join(told, ["_kd", "_kt", "term"], "left_semi").groupBy("_kd", "_kt").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(TERM).alias("kind"))).alias("extra"))
    slim = slim.join(extra, ["_kd", "_kt"], "left")
    extra_col = F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))
    out = stored(slim.select("_kd", "_kt", F.col("_key").alias(key), base.alias("base"), F.array_sort(F.concat(base, extra_col)).alias("spans")), "pii-found")
    for done in (first, words, seen, told):
        discard(done)
    return out


def _telling(docs: DataFrame, seen: DataFrame, there: DataFrame, total: float, threshold: float, least_texts: int) -> DataFrame:
    """(_kd, _kt, term), stored: which terms give an entity of their text away. docs: all texts; seen: the entities of texts; there: the terms of
    texts with entities."""

    def share(n_et: Column, n_e: str, n_t: str) -> Column:
        return F.log(n_et * F.lit(total) / (F.col(n_e) * F.col(n_t))) / F.log(F.lit(total) / F.col(n_e))

    can = lambda n_e, n_t: share(F.least(n_e, n_t), n_e, n_t) >= threshold - 1e-9  # noqa: E731  together in as many documents as can be
    enough = lambda g: g.filter(F.col("texts") >= least_texts).drop("texts")
    entities = enough(seen.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"), F.sum(F.xxhash64("_kd", "_kt").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "_kd", "_kt")).alias("y")).filter(F.col("n_e") < total))
    # entities of the same documents count alike: the first of them stands for all
    entities = stored(entities.groupBy("n_e", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "n_e"), "pii-entity-counts")
    seen = stored(seen.join(entities, "entity"), "pii-mentions")
    texts = seen.groupBy("_kd", "_kt").agg(F.min("n_e").alias("rarest"), F.max("n_e").alias("most"), F.count("*").alias("many"))
    # a term is in at least as many documents as it stands in with entities, so what falls short even so needs no count of the corpus
    at_least = there.groupBy("term").agg(F.sum("copies").alias("n_least"))
    likely = stored(there.join(texts, ["_kd", "_kt"]).join(at_least, "term").filter(can("most", "n_least")).drop("n_least"), "pii-likely")
    # all terms of the corpus are counted, in partial sums within tasks, so what is shuffled is vocabulary and not text
    every = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(TOKEN), F.lit(0)))).alias("term"))
    counted = every.groupBy("term").agg(F.count("*").alias("n_t")).join(likely.select("term").distinct(), "term")
    judged = stored(likely.join(counted, "term").filter(can("most", "n_t")).withColumn("sure", (share(F.lit(1.0), "rarest", "n_t") >= threshold) & F.lit(least_texts <= 1)), "pii-judged")
    sure = judged.filter("sure").select("_kd", "_kt", "term")
    # terms that are open in some text meet the entities that the bound admits, texts with very many entities in shares of them
    open_ = judged.filter("not sure").select("term").distinct()
    shares = F.least(F.lit(64), F.floor(F.col("many") / 256) + 1).cast("int")
    terms = judged.join(open_, "term", "left_semi").select("_kd", "_kt", "copies", "term", "n_t", F.explode(F.sequence(F.lit(0), shares - 1)).alias("part"))
    mentions = seen.join(texts.select("_kd", "_kt", "many"), ["_kd", "_kt"]).select("_kd", "_kt", "entity", "n_e", F.pmod(F.xxhash64("entity"), shares).cast("int").alias("part"))
    together = stored(terms.join(mentions, ["_kd", "_kt", "part"]).filter(can("n_e", "n_t")).drop("part"), "pii-together")
    pairs = enough(together.groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"), F.count_distinct("_kt").alias("texts")))
    telling = pairs.filter(share(F.col("n_et"), "n_e", "n_t") >= threshold).select("entity", "term")
    told = stored(sure.union(together.join(telling, ["entity", "term"], "left_semi").select("_kd", "_kt", "term")).distinct(), "pii-told")
    for done in (entities, seen, likely, judged, together):
        discard(done)
    return told


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(df: DataFrame, key: str, text: str = "text", **how) -> DataFrame:
    """df with [KIND] in place of every span of its text; spans that overlap are replaced together, by the first one's kind. Null
    texts stay null, empty ones empty, repeated rows all get the same text; other columns stay as they are, whatever their names."""
    whole = find_spans(df, key, text, **how)
    found = whole.filter(F.size("spans") > 0).select("_kd", "_kt", F.col("spans").alias("_spans")).dropDuplicates(["_kd", "_kt"])
    keyed = df.withColumns({"_kd": F.xxhash64(F.lit(1), key), "_kt": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    body = F.col(text)

    clean = cleaned(body, F.col("_spans"))
    out = stored(keyed.join(found, ["_kd", "_kt"], "left").withColumn(text, F.when(F.col("_spans").isNull(), body).otherwise(clean)).select(*[F.col(f"`{c}`") for c in df.columns]), "sanitised")
    discard(whole)
    return out


def cleaned(body: Column, spans: Column) -> Column:
    """The text with [KIND] in place of spans (in order of start); chunk by chunk, each with the spans that reach into it."""
    # the furthest end of all spans before one says whether it is replaced on its own or with those before
    end = lambda p: F.coalesce(F.array_max(F.transform(p, lambda s: s["end"])), F.lit(0))
    kind = "array<struct<start:int,end:int,kind:string,new:boolean>>"

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (s["start"] >= acc["at"]).alias("new"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    each = lambda p, at: F.struct(F.get(p, F.lit(0))["start"].alias("lo"), F.greatest(at, end(p)).alias("hi"), F.aggregate(p, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"]).alias("spans"))
    runs = _bound(_pieces(spans), lambda ps: F.zip_with(ps, _before(ps, end, F.lit(0), F.greatest), each))

    def chunk(c: Column, runs: Column) -> Column:
        lo, hi = c * CHUNK, (c + 1) * CHUNK

        def put(part: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                gap = F.substring(part, acc["at"] - lo + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
                label = F.when(s["new"] & (s["start"] >= lo), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
                return F.struct(F.least(F.greatest(acc["at"], s["end"]), hi).alias("at"), F.concat(acc["out"], F.array(gap, label)).alias("out"))

            near = F.flatten(F.transform(F.filter(runs, lambda r: (r["lo"] < hi) & (r["hi"] > lo)), lambda r: F.filter(r["spans"], lambda s: (s["start"] < hi) & (s["end"] > lo))))
            return F.aggregate(near, F.struct(lo.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(part, acc["at"] - lo + 1, F.lit(CHUNK))))

        return _bound(F.substring(body, lo + 1, F.lit(CHUNK)), put)

    return F.array_join(_bound(runs, lambda r: F.transform(F.sequence(F.lit(0), F.floor(F.length(body) / CHUNK).cast("int")), lambda c: chunk(c, r))), "")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and all spans of every document, every pair of entity and term judged."""
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, "doc_id")
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
