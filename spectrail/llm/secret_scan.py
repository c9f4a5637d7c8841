"""Secrets in texts, with DataFrame functions only: fixed patterns, and strings that look random.

Fixed patterns: assignments to names like password or token, access keys and long hexadecimal runs. The rest by two
character Markov models, of random strings and of ordinary identifiers, trained from labelled samples by counting pairs
of neighbouring characters (add-one smoothed): a run of 20 characters or more with a letter is a secret if the log
likelihood ratio of the models is at least `total` in sum and `mean` for each pair, and it has LEAST_CHARS different characters. total = 15 holds where ordinary runs
are up to e^15, some 3 million, times as frequent as secrets; mean = 0.5 keeps long ordinary runs from adding up small
sums. By these, of random strings over letters and digits 0.90 are found at 20 characters, 0.97 at 24 and all at 32.

The labelled samples are made by a rule from fixed words, the same in every session: words of several languages, alone and
joined as identifiers and paths are, character sequences of keyboards and alphabets, and one character again and again as
ordinary; digests in several alphabets as random.

Positions come from the texts before and of the matches: each match of \\G(.*?)(pattern) begins where the last one
ended, so the lengths add up to code-point positions. Running sums are taken in runs of STRETCH matches, and the text is cut
into pieces by runs of BLOCK characters, so the time grows with the matches and not with their square. Texts without a cheap
sign of a pattern are not searched further.

Defined cases: null and empty texts have no spans; matches at equal starts are ordered by kind as in KINDS; a text of
any length is searched whole; repeated rows are searched alike; a null id stays null; an empty table gives an empty
result; find_secrets() neither reads nor returns other columns, redact() keeps all columns and uses no helper column.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "markov"]
#: Name, value and least length of each kind; a sign without which a text can't match.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_SIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS, ACCESS_LEAST = "AKIA[A-Z0-9]+", 16
HEX, HEX_LEAST = "[0-9a-f]{32,}", 32
RUN_CHARS, RUN_LEAST, LEAST_CHARS = "A-Za-z0-9+/_=-", 20, 6
RUN = f"[{RUN_CHARS}]{{{RUN_LEAST},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SPANS = "array<struct<start:int,kind:int,stop:int>>"


#: Matches and characters that are gone through one by one within running sums, and within a text.
STRETCH, BLOCK = 128, 1024

#: Words that samples of ordinary strings are made of: of programs, and frequent ones of some languages.
CODE = """access account action active address admin agent alert amount array asset async author average background backup balance base
batch before block body bool bottom branch buffer build bundle button byte cache call cancel card category chain change channel
check child class clean client close cloud cluster code collection color column command comment commit common compare component
config connection container content context control copy count create current custom data database date debug decode default
delete description detail device dictionary directory disk document domain download driver dynamic edge editor element email
enable encode end engine entry error event exception execute export external factory feature field file filter final find first
flag folder format function gateway general get global graph group handler header height hidden history host id image import
index info init input insert instance integer interface internal invalid item iterator job join key label language last layout
length level library limit line link list local location lock log main manager map master max memory menu message meta method
metric min mode model module month mount name network next node null number object offset open operation option order output
owner package page parallel parameter parent parse partition path pattern payload percent period plan platform plugin point policy
pool port position prefix primary print priority private process product profile program project property protocol provider proxy
public query queue random range rate read record reference refresh region register release remote remove render replace report
request reset resource response result retry return role root route row rule run sample scan schedule schema scope script search
section select sequence server service session set shape shared signal size snapshot socket sort source space spec stage start
state static status step stop storage store stream string style submit subscription summary support switch symbol sync system
table tag target task template test text thread time title total trace track transaction transform tree trigger type unit update
upload url user utils valid value variable vector version view virtual volume wait warning watch web width window word worker
write year zone"""
PROSE = """about after again because before between country different everything government important information little national
nothing people possible question something together university without international understanding responsibility development
aber alle andere arbeit auch beziehung deutsche einfach entwicklung erfahrung freiheit gegen geschichte gesellschaft immer jahr
krankenversicherung leben mehr mensch nicht nur ohne schule sprache straßenbahn überall verantwortung wissenschaft zwischen
alors ancien après avec beaucoup chaque comme développement dans depuis économique encore enfant entreprise établissement
gouvernement heureusement histoire jamais lorsque maintenant nouveau particulièrement pendant premier quelque toujours vieux
ahora algunos año aunque cada ciudad conocimiento cuando desarrollo después durante empresa entonces español gobierno grande
hacer historia información lugar mañana mientras muchos nuestro posible primero siempre también tiempo trabajo universidad
allora anche bambini città comunicazione cosa della dopo essere giorno lavoro molto ogni perché persona quando sempre sviluppo
bardzo bezpieczeństwo chrząszcz człowiek dlaczego jeszcze każdy międzynarodowy nauczyciel odpowiedzialność państwo przedsiębiorstwo
przez przyszłość rozwój rzeczywistość również społeczeństwo szczęście szkoła trzeba wszystko wykształcenie zmiana życie"""
SEQUENCES = "abcdefghijklmnopqrstuvwxyz qwertyuiop asdfghjkl zxcvbnm qwertyuiopasdfghjklzxcvbnm azertyuiopqsdfghjklmwxcvbn 0123456789 1234567890 0123456789abcdef"


def labelled_samples(spark: SparkSession, rows: int = 2000) -> DataFrame:
    """(text, random): digests in hexadecimal, base 64 and letters as random strings; names of one to five words of CODE in
    the usual ways to join them, words of PROSE, all parts of SEQUENCES forward and back, and repeated characters as ordinary ones."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    encoded = F.base64(F.unhex(digest))
    chance = F.array(F.substring(digest, 1, 40), encoded, F.regexp_replace(encoded, "[^A-Za-z0-9]", ""), F.upper(F.regexp_replace(encoded, "[^A-Za-z0-9]", "")))
    words = F.split(F.lit(" ".join(CODE.split())), " ")
    pick = F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: F.get(words, F.pmod(F.xxhash64("id", i), F.size(words)).cast("int")))
    camel = F.transform(F.col("_w"), lambda w: F.initcap(w))
    lower = F.concat(F.lower(F.substring(F.array_join(camel, ""), 1, 1)), F.substring(F.array_join(camel, ""), 2, 200))
    number = F.concat(F.array_join("_w", "_"), F.lit("_"), (F.col("id") % 1000).cast("string"))
    joined = F.array(*(F.array_join("_w", by) for by in ("_", "-", "/", "")), F.upper(F.array_join("_w", "_")), F.array_join(camel, ""), lower, number)
    names = spark.range(0, 4 * rows, 1, 4).select("id", pick.alias("_w")).select(F.explode(joined).alias("text"))
    said = spark.range(1).select(F.explode(F.split(F.lit(" ".join([*PROSE.split(), *CODE.split()] * 4)), " ")).alias("text"))
    said = said.union(said.select(F.initcap("text"))).union(said.select(F.upper("text")))
    lines = spark.range(1).select(F.explode(F.split(F.lit(SEQUENCES), " ")).alias("_s"))
    lines = lines.union(lines.select(F.reverse("_s")))
    lines = lines.union(lines.select(F.upper("_s")))
    lines = lines.select("_s", F.explode(F.sequence(F.lit(1), F.char_length("_s"))).alias("_i")).select(F.explode(F.array(*(F.substring("_s", F.col("_i"), F.lit(n)) for n in (4, 6, 8, 30)))).alias("text"))
    same = spark.range(1).select(F.explode(F.split(F.lit(ALPHABET), "")).alias("c")).select(F.repeat("c", 100))
    plain = names.union(said).union(lines).union(same)
    return spark.range(0, rows, 1, 4).select(F.explode(chance).alias("text"), F.lit(1).alias("random")).union(plain.select("text", F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """log P(random) - log P(identifier) of each pair of characters of ALPHABET, row by row.

    samples: text, random (0 or 1); nulls are skipped. What comes back is at most twice the square of the alphabet.
    """
    chars = F.split("text", "")
    pairs = samples.where("text is not null and random is not null and length(text) > 1").select("random", F.explode(F.arrays_zip(F.slice(chars, 1, F.length("text") - 1).alias("a"), F.slice(chars, 2, F.length("text") - 1).alias("b"))).alias("p"))
    known = pairs.select("random", "p.a", "p.b").where(F.instr(F.lit(ALPHABET), F.col("a")).between(1, 99) & (F.instr(F.lit(ALPHABET), F.col("b")) > 0))
    counts = {(bool(r["random"]), r["a"], r["b"]): r["n"] for r in known.groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = []
    for a in ALPHABET:
        sums = {k: sum(counts.get((k, a, b), 0) + 1 for b in ALPHABET) for k in (True, False)}
        table += [math.log((counts.get((True, a, b), 0) + 1) / sums[True]) - math.log((counts.get((False, a, b), 0) + 1) / sums[False]) for b in ALPHABET]
    return table


def likelihood_ratio(text: Column, table: Column) -> Column:
    """Log likelihood ratio of a string over ALPHABET: above 0 where the model of random strings fits better."""
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    first = F.struct(F.lit(-1).alias("code"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("code"), (acc["sum"] + F.when(acc["code"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["code"] * len(ALPHABET) + c))).alias("sum"))
    return F.aggregate(codes, first, step, lambda acc: acc["sum"])


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, first: Column, step) -> Column:
    """step() over the values up to and with each, from first: within stretches, and over what the stretches give. step
    must be associative."""
    fold = lambda a: F.aggregate(a, first, step)

    def stretches(v: Column) -> Column:
        count = F.ceil(F.size(v) / STRETCH).cast("int")
        cut = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda b: F.slice(v, b * STRETCH + 1, F.lit(STRETCH)))

        def within(parts: Column) -> Column:
            sums = F.transform(parts, fold)
            each = lambda totals: F.flatten(F.transform(parts, lambda part, b: _let(fold(F.slice(totals, F.lit(1), b)), lambda base: F.transform(part, lambda x, i: step(base, fold(F.slice(part, F.lit(1), i + 1)))))))
            return _let(sums, each)

        return _let(cut, within)

    return _let(values, stretches)


def _matches(text: Column, pattern: str, kind: int, sign: Column, keep, value_group: int = 2) -> Column:
    """Spans of the leftmost non-overlapping matches of pattern that keep() holds for."""
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    parts = [F.regexp_extract_all(text, whole, F.lit(i)) for i in dict.fromkeys((1, 2, value_group))]
    names = ["before", "match", "value"][: len(parts)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, names, strict=True)))

    def spans(found: Column) -> Column:
        ends = _running(F.transform(found, lambda x: F.char_length(x["before"]) + F.char_length(x["match"])), F.lit(0), lambda a, b: a + b)
        span = lambda stops: F.transform(found, lambda x, i: F.when(keep(x[names[-1]]), F.struct((F.get(stops, i) - F.char_length(x["match"])).alias("start"), F.lit(kind).alias("kind"), F.get(stops, i).alias("stop"))))
        return F.filter(_let(ends, span), lambda s: s.isNotNull())

    return F.when(sign, _let(zipped, spans)).otherwise(F.expr(f"cast(array() as {SPANS})")).cast(SPANS)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, in order of start and kind."""
    least = lambda n: lambda x: F.char_length(x) >= n
    found = [
        _matches(text, f"(?i:{ASSIGN})", 0, text.rlike(ASSIGN_SIGN), least(8), 4),
        _matches(text, ACCESS, 1, F.contains(text, F.lit("AKIA")), least(ACCESS_LEAST)),
        _matches(text, HEX, 2, text.rlike(HEX), least(HEX_LEAST)),
    ]
    return F.array_sort(F.concat(*found))


def is_random(run: Column, table: list[float], total: float = 15.0, mean: float = 0.5) -> Column:
    """Whether the model of random strings fits a run of characters of ALPHABET clearly better."""
    ratio = likelihood_ratio(run, F.from_json(F.lit(json.dumps([round(x, 3) for x in table])), "array<double>"))
    return run.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(run, ""))) >= LEAST_CHARS) & (ratio >= total) & (ratio >= mean * (F.char_length(run) - 1))


def evaluate(samples: DataFrame, table: list[float], total: float = 15.0, mean: float = 0.5) -> DataFrame:
    """(recall, precision, n_random, n_ordinary) over labelled samples that are runs as a text's are."""
    runs = samples.where(F.col("text").rlike(f"^{RUN}$") & F.col("random").isNotNull())
    said = F.when(is_random(F.col("text"), table, total, mean), 1).otherwise(0)
    sums = runs.select("random", said.alias("said")).agg(F.sum(F.col("random") * F.col("said")).alias("hit"), F.sum("said").alias("said"), F.sum("random").alias("n_random"), F.sum(1 - F.col("random")).alias("n_ordinary"))
    return sums.select(F.try_divide("hit", "n_random").alias("recall"), F.try_divide("hit", "said").alias("precision"), "n_random", "n_ordinary")


def random_spans(text: Column, table: list[float], total: float = 15.0, mean: float = 0.5) -> Column:
    """Spans of long runs that the model of random strings fits clearly better."""
    return _matches(text, RUN, 3, text.rlike(RUN), lambda x: is_random(x, table, total, mean))


def find_secrets(documents: DataFrame, table: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (start, kind as an index of KINDS, stop; code points): the fixed patterns', and all."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", base_spans(F.col("_text")).alias("base"), random_spans(F.col("_text"), table).alias("random"))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "random")).alias("spans"))


def span_text(spans: str | Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(documents: DataFrame, table: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with each stretch of text that spans cover replaced by mark. Null texts stay null."""
    body = F.col(text)

    def pieces(blocks: Column, spans: Column) -> Column:
        """What stands before each span that begins a stretch of its own, with the mark, and what follows the last."""

        def between(start: Column, stop: Column) -> Column:
            part = lambda j: F.substring(F.get(blocks, j), F.greatest(start - j * BLOCK, F.lit(0)) + 1, F.least(stop - j * BLOCK, F.lit(BLOCK)) - F.greatest(start - j * BLOCK, F.lit(0)))
            return F.when(stop > start, F.array_join(F.transform(F.sequence(F.floor(start / BLOCK).cast("int"), F.floor((stop - 1) / BLOCK).cast("int")), part), "")).otherwise(F.lit(""))

        def joined(reach: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
            kept = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(before(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(kept, ""), between(before(F.size(spans)), F.char_length(body)))

        return _let(_running(F.transform(spans, lambda s: s["stop"]), F.lit(0), lambda a, b: F.greatest(a, b)), joined)

    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    done = _let(F.array_sort(F.concat(base_spans(body), random_spans(body, table))), lambda spans: _let(cut, lambda blocks: pieces(blocks, spans)))
    touched = body.rlike(ASSIGN_SIGN) | F.contains(body, F.lit("AKIA")) | body.rlike(HEX) | body.rlike(RUN)
    return documents.withColumn(text, F.when(touched, done).otherwise(body))
