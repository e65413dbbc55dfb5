"""Texts cut off by field limits or mid-transfer.

First the hidden limits. The length of every open text (no closing punctuation, or a mark of omission) is recomputed
under several storage forms (characters, UTF-8 bytes, UTF-16 units, HTML- and JSON-escaped, CRLF line ends) and
counted by site, form and length. Where a site's open texts pile up at one length, their endings are inspected: if at
least half of them end as the corpus hardly ever does, the site has a limit there, and all its open texts of that
length were cut, whatever their own ending. Then the endings of all other open texts, for what was lost in transfer.

Endings are held against counts over the whole corpus, each distinct text once: how often the last word and the last
two words go on, end a sentence or end a text, and how often longer words start with the last word. A word that only
exists as the start of others was cut; so was a sentence that ends where the corpus never ends one. A mark of omission
is evidence unless the corpus always stops at these words ("to be continued"), judged by the last two words or by the
whole last sentence where it has two to four words.

Every distinct text is read once, whatever the number of its elements. All counts are by aggregation and equi-join
over the whole table; prefixes are counted in a stream of sorted words, none is multiplied out beyond seven letters;
nothing is collected. Texts are compared in their consistent form (`normalise`), lengths are those of the stored text.

Defined cases: null and empty texts and texts without a letter are no cases; texts of fewer than `least_words` words,
or of mostly numbers, are judged by a limit or a cut last word, with or without a mark: one that starts longer words,
or goes on in another text with the same words before it (both, where it is the only word); they are whole if they
stand so on several sites. A lone letter after a number or in upper case is a label, not a cut word, unless another
text goes on there. Identical rows and repeated texts count once in the statistics; a text met by several limits is
reported once; texts are processed whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.normalise import consistent
from veilmark.session import cut

MARK = re.compile(r"\s*(?:\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|…|\.{3,})\s*\Z")
CLOSED = re.compile(r"[.!?:;。！？…][\"'”’»)\]]*\Z")
WORD = re.compile(r"([^\W_]+(?:['’\-][^\W_]+)*)")
ENDS = re.compile(r"[\"'”’»)\]]*[.!?…。！？]")
OMITTED = re.compile(r"\s*[\[(]?\s*(?:…|\.{3})")
OPEN_TAIL = re.compile(r"\s*[,;–—]\s*\Z")
FORMS = ("chars", "bytes", "utf16", "html", "html_bytes", "json", "crlf")
#: Words at a sentence's start that are also counted with all words before them.
OPENING = 4
FLUSH = 200_000


def maybe_open(text: Column) -> Column:
    """Texts with letters that may be unfinished: a superset, decided by the last characters alone."""
    marked = F.rtrim(text, F.lit(" )]"))
    closed = F.right(F.rtrim(text, F.lit("\"'”’»)]")), F.lit(1)).isin(*".!?:;。！？…")
    # as one CASE, or a Bloom filter of it would be built by one more scan
    return F.when(marked.endswith("…") | marked.endswith("..."), True).when(closed, False).otherwise(text.rlike(r"\p{L}"))


def lengths(text: str) -> list[int]:
    """Length of a text under each of FORMS."""
    n = len(text)
    escaped = text.count("\n") + text.count("\r") + text.count("\t") + text.count('"') + text.count("\\")
    html = 4 * text.count("&") + 3 * text.count("<") + 3 * text.count(">") + 5 * text.count('"') + 4 * text.count("'")
    if text.isascii():
        size = utf16 = json = n
    else:
        size = len(text.encode("utf-8", "surrogatepass"))
        utf16 = len(text.encode("utf-16-le", "surrogatepass")) // 2
        json = utf16 + 5 * (utf16 - sum(c < "\x80" for c in text))
    return [n, size, utf16, n + html, size + html, json + escaped, n + text.count("\n")]


def hashes(text: Column) -> list[Column]:
    """128 bits that stand for a text in joins."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(7)).alias("h2")]


def distinct_texts(elements: DataFrame) -> DataFrame:
    """(text, n_sites): the distinct texts that have a letter, with the number of sites they stand on."""
    rows = elements.filter(F.col("text").rlike(r"\p{L}")).select("site", "text").distinct()
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n_sites"))


def _words(text: str) -> tuple[list[str], list[str]]:
    """Words in lower case, and what follows each."""
    parts = WORD.split(text)
    return [w.lower() for w in parts[1::2]], parts[2::2]


def _count_endings(words: list[str], tails: list[str], seen: dict[tuple[str, str], list[int]]) -> None:
    """Adds the words of one text to seen: (prev, word) -> total, ended, final, omitted."""
    last, at, history, prev = len(words) - 1, 0, "^", "^"
    for i, w in enumerate(words):
        tail = tails[i]
        ended = final = omitted = 0
        if tail != " ":
            ended = int(ENDS.match(tail) is not None)
            final = int(i == last and not ended)
            omitted = int(OMITTED.match(tail) is not None)
        for key in ((prev, w), (history, w)) if 0 < at < OPENING else ((prev, w),):
            row = seen.get(key)
            if row is None:
                seen[key] = [1, ended, final, omitted]
            else:
                row[0] += 1
                if tail != " ":
                    row[1] += ended
                    row[2] += final
                    row[3] += omitted
        if ended:
            prev, at, history = "^", 0, "^"
        else:
            prev, at = w, at + 1
            if at < OPENING:
                history = f"{history} {w}"


def _open_end(t: str, least_words: int) -> dict | None:
    """The last words of a text in consistent form; None where it is closed. `start` has all words of a short one."""
    mark = MARK.search(t)
    if not mark and CLOSED.search(t):
        return None
    body = t[: mark.start()] if mark else t
    words, tails = _words(body)
    n = len(words)
    if not n or not any(c.isalpha() for c in body):
        return None
    stops = [i for i in range(n - 1) if tails[i] != " " and ENDS.match(tails[i])]
    first = stops[-1] + 1 if stops else 0
    prev = words[-2] if n - 1 > first else "^"
    short = n < least_words or sum(w[0].isalpha() for w in words) < 3
    return {
        "prev": prev, "word": words[-1], "marked": mark is not None, "n_words": n, "prose": bool(stops), "history": "^ " + " ".join(words[first:-1]) if 2 <= n - first <= OPENING else None,
        "open_tail": OPEN_TAIL.match(tails[-1]) is not None, "letter": len(words[-1]) == 1 and (prev[0].isdigit() or not body[: len(body) - len(tails[-1])][-1:].islower()), "start": " ".join(words) if short else None,
    }


READ = (
    "kind string, prev string, word string, total long, ended long, final long, omitted long, h1 long, h2 long, marked boolean, n_words int, prose boolean, history string, open_tail boolean, "
    "letter boolean, start string, lengths array<int>"
)


def read(texts: DataFrame, least_words: int = 4) -> DataFrame:
    """Everything the operator has to know of distinct texts (text, n_sites), in one pass over them. Rows of three kinds:

    pair: how a word goes on after the one before it. prev is '^' at a sentence's start; the 2nd to 4th word of a
    sentence are also counted with all words before them, behind '^ '. Summed within a task, as starts are.
    start: the first `least_words` - 1 words of texts; total: the sites they stand on, final: those where no word follows.
    text: the last words and the lengths of an open text.
    """
    names = [c.split()[0] for c in READ.split(", ")]

    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], list[int]] = {}
        firsts: dict[str, list[int]] = {}

        def counts() -> pd.DataFrame:
            rows = [("pair", p, w, *v) for (p, w), v in seen.items()] + [("start", None, k, n, 0, own, 0) for k, (n, own) in firsts.items() if k]
            seen.clear()
            firsts.clear()
            return pd.DataFrame([(*r, *[None] * (len(names) - 7)) for r in rows], columns=names, dtype=object)

        for batch in batches:
            ends = []
            for text, n_sites, h1, h2 in zip(batch["text"], batch["n_sites"].tolist(), batch["h1"].tolist(), batch["h2"].tolist(), strict=True):
                t = consistent(text)
                words, tails = _words(t)
                _count_endings(words, tails, seen)
                row = firsts.setdefault(" ".join(words[: least_words - 1]), [0, 0])
                row[0] += n_sites
                row[1] += n_sites if len(words) < least_words else 0
                end = _open_end(t, least_words)
                if end:
                    ends.append({"kind": "text", "h1": h1, "h2": h2, "lengths": lengths(text), **end})
            yield pd.DataFrame(ends, columns=names, dtype=object)
            if len(seen) > FLUSH:
                yield counts()
        yield counts()

    typed = lambda flow: lambda batches: (f.astype({c: "Int64" for c in ("total", "ended", "final", "omitted", "h1", "h2", "n_words")} | {c: "boolean" for c in ("marked", "prose", "open_tail", "letter")}) for f in flow(batches))
    return texts.select("text", "n_sites", *hashes(F.col("text"))).mapInPandas(typed(flow), READ)


def continued(entries: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """(word, longer): summed `n` of the distinct entries (word, n) that go on, within a word, where an asked word ends.

    Asked words of under k characters are counted by a join with the entries' first letters; the others in a stream of
    sorted words spread by their first k characters, where the asked words that the present one continues form a stack.
    """
    asked = asked.select("word").distinct()
    cuts = F.filter(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: (i < F.length("word")) & (F.substring("word", i + 1, F.lit(1)) != " "))
    heads = entries.select(F.explode(F.transform(cuts, lambda i: F.left("word", i))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("longer"))
    small = heads.join(asked.filter(F.length("word") < k), "word", "left_semi")

    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []
        for batch in batches:
            done = []
            for word, n, is_asked in zip(batch["word"], batch["n"], batch["asked"], strict=True):
                while stack and not word.startswith(stack[-1][0]):
                    done.append(stack.pop())
                for entry in stack:
                    if word[len(entry[0])] != " ":
                        entry[1] += n
                if is_asked:
                    stack.append([word, 0])
            yield pd.DataFrame(done, columns=["word", "longer"])
        yield pd.DataFrame(stack, columns=["word", "longer"])

    both = entries.select("word", "n", F.lit(False).alias("asked")).unionByName(asked.select("word", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    both = both.filter(F.length("word") >= k).groupBy("word").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    large = both.repartition(F.left("word", F.lit(k))).sortWithinPartitions("word").mapInPandas(flow, "word string, longer long")
    return small.unionByName(large.filter("longer > 0"))


def ending_evidence(found: DataFrame) -> DataFrame:
    """The open texts of `read` with `bad` (an ending that was cut) and `stock` (a mark that always stands there)."""
    rows = found.filter("kind = 'text'").select("h1", "h2", "prev", "word", "marked", "n_words", "prose", "history", "open_tail", "letter", "start", "lengths")
    pairs = found.filter("kind = 'pair'").groupBy("prev", "word").agg(*[F.sum(c).alias(c) for c in ("total", "ended", "final", "omitted")])
    single = found.filter("kind = 'pair' AND NOT startswith(prev, '^ ')").groupBy("word").agg(F.sum("total").alias("word_total"), (F.sum("ended") + F.sum("final")).alias("word_last"))
    longer = continued(single.select("word", F.col("word_total").alias("n")), rows.select("word"))
    words = single.join(longer, "word", "left")
    first = found.filter("kind = 'start'").groupBy(F.col("word").alias("start")).agg(F.sum("total").alias("n"), F.sum("final").alias("own"))
    going = continued(first.select(F.col("start").alias("word"), "n"), rows.filter("start IS NOT NULL").select(F.col("start").alias("word")))
    going = first.filter("own > 0").select("start", "own").join(going.withColumnsRenamed({"word": "start", "longer": "continued"}), "start", "full")
    of = lambda name: pairs.withColumnsRenamed({c: f"{name}_{c}" for c in ("total", "ended", "final", "omitted")})
    found = rows.join(of("pair"), ["prev", "word"], "left").join(words, "word", "left")
    # only marked texts ask for their last sentence, only short ones for their start; the others are passed by
    asks = found.filter("marked AND history IS NOT NULL").select("history", "word").distinct()
    found = found.join(asks.join(of("open").withColumnRenamed("prev", "history"), ["history", "word"]), ["history", "word"], "left")
    # texts without a start are spread by their own hash
    found = found.withColumn("sk", F.coalesce("start", F.concat(F.lit("\n"), F.col("h1").cast("string")))).join(going.withColumnRenamed("start", "sk"), "sk", "left")
    counts = ["pair_total", "pair_ended", "pair_final", "pair_omitted", "open_total", "open_ended", "open_final", "open_omitted", "word_total", "word_last", "longer", "own", "continued"]
    found = found.fillna(0, counts)
    # without the text itself
    pair_total, pair_last = F.col("pair_total") - 1, F.col("pair_ended") + F.col("pair_final") - 1
    word_total, word_last = F.col("word_total") - 1, F.col("word_last") - 1
    pair_end, word_end = F.when(pair_total >= 5, pair_last / pair_total), F.when(word_total >= 5, word_last / word_total)
    goes_on = F.col("word_total") - F.col("word_last")
    fragment = (F.col("longer") >= 10) & (goes_on * 20 <= F.col("longer")) & (word_last * 40 <= F.col("longer")) & ~F.col("word").rlike("[0-9]")
    # after whole sentences, the corpus hardly ever stops at these two words
    never = F.coalesce(word_end < 0.02, F.lit(False)) | (F.col("prose") & F.coalesce(pair_end < 0.04, F.lit(False)))
    # words that always end a text, and mostly with a mark: "to be continued"
    always = lambda total, last, omitted: (total >= 5) & (last >= 0.97 * total) & (2 * omitted >= last + 1)
    open_total, open_last = F.col("open_total") - 1, F.col("open_ended") + F.col("open_final") - 1
    stock = F.col("marked") & (always(pair_total, pair_last, F.col("pair_omitted")) | always(open_total, open_last, F.col("open_omitted")))
    # short texts: only a cut word counts
    goes = (F.col("continued") > 0) & (never | (goes_on * 20 <= F.col("longer")))
    repeated = (F.col("own") >= 2) & (F.col("own") * 20 > F.col("continued"))
    short = ~repeated & F.when(F.col("n_words") == 1, fragment & goes).otherwise((fragment & ~F.col("letter")) | goes)
    bad = F.when(F.col("start").isNotNull(), short).when(F.col("marked"), fragment | ~stock).otherwise(F.col("open_tail") | fragment | never)
    return found.select("h1", "h2", "lengths", fragment.alias("fragment"), never.alias("never"), stock.alias("stock"), bad.alias("bad"))


def limits(rows: DataFrame, least: int = 4, peak: float = 4.0, reach: int = 3, confirm: float = 0.5) -> DataFrame:
    """(site, form, length, n, n_bad): hidden limits, from each site's distinct open texts (site, lengths, bad).

    least: texts at that length; peak: how far they exceed the average of the `reach` lengths on either side; confirm:
    the least share of them whose ending was cut.
    """
    d = rows.select("site", "bad", F.posexplode("lengths").alias("form", "length"))
    d = d.groupBy("site", "form", "length").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
    w = Window.partitionBy("site", "form").orderBy("length").rangeBetween(-reach, reach)
    d = d.withColumn("near", (F.sum("n").over(w) - F.col("n")) / (2 * reach))
    d = d.filter((F.col("n") >= least) & (F.col("n") >= peak * (F.col("near") + 0.25)) & (F.col("n_bad") >= confirm * F.col("n"))).drop("near")
    return d.withColumn("form", F.get(F.array(*[F.lit(f) for f in FORMS]), F.col("form")))


def judged(elements: DataFrame, least_words: int = 4) -> DataFrame:
    """(site, h1, h2, lengths, evidence...) of each site's distinct open texts; evidence: limit, ending, or null where it is whole.

    What was read of the texts, and what their endings say, is written to the checkpoint folder: both are used twice.
    """
    found = ending_evidence(cut(read(distinct_texts(elements), least_words)))
    known = elements.filter(maybe_open(F.col("text"))).select("site", *hashes(F.col("text"))).distinct()
    rows = cut(known.join(found, ["h1", "h2"]))
    # at most one entry a length a site's texts have
    at = limits(rows).groupBy("site").agg(F.collect_list(F.struct("form", "length")).alias("limits"))
    of = F.map_from_arrays(F.array(*[F.lit(f) for f in FORMS]), F.col("lengths"))
    rows = rows.join(at, "site", "left").withColumn("limited", F.coalesce(F.exists("limits", lambda x: of[x["form"]] == x["length"]), F.lit(False)) & ~F.col("stock")).drop("limits")
    return rows.withColumn("evidence", F.when(F.col("limited"), "limit").when(F.col("bad"), "ending"))


def cut_elements(elements: DataFrame) -> DataFrame:
    """(page_id, element_id, evidence) of the elements whose text was cut off, each once."""
    found = judged(elements).filter(F.col("evidence").isNotNull()).select("site", "h1", "h2", "evidence")
    rows = elements.filter(maybe_open(F.col("text"))).select("page_id", "element_id", "site", *hashes(F.col("text")))
    return rows.join(found, ["site", "h1", "h2"]).groupBy("page_id", "element_id").agg(F.max("evidence").alias("evidence"))


def site_rates(elements: DataFrame) -> DataFrame:
    """(site, n_texts, n_cut, cut_share) over distinct elements."""
    all_texts = elements.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("site", "page_id", "element_id").distinct()
    found = cut_elements(elements).select("page_id", "element_id", F.lit(1).alias("c"))
    rows = all_texts.join(found, ["page_id", "element_id"], "left")
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("n_texts"), F.count("c").alias("n_cut")).withColumn("cut_share", F.col("n_cut") / F.col("n_texts"))
