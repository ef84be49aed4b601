"""Deny and allow lists that are tables: terms of any number, found where they stand between characters that are of no word.

Terms that are counted few go to every task as one automaton. Others are joined by their first two words with the places of
the texts where a term may begin, and compared there and then; terms of more than SHORT characters are compared with the whole
texts where their beginnings were found. If a term's first word alone is as long, one of its words, the one that the fewest rows
have, is joined with the words of the texts, and where both meet the whole term is compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import cut, let, pages
from .words import tokens

#: Most terms, and most characters of them, that go to every task.
TERMS, CHARACTERS = 20_000, 1_000_000
#: Most words of a list of terms, and most characters of the terms that hold them, that its joins broadcast.
WORDS, HELD = 500_000, 20_000_000
#: Most characters of a term that is looked for in pieces of texts, and characters from one piece to the next.
SHORT, PIECE = 128, 256
#: Bits of the map of a longer list's first words, which keeps other places off the shuffle (8 MB).
BITS = 1 << 26
WORD = r"\w+"
FOUND = "array<struct<term:string,start:int,end:int>>"


def listed(terms: DataFrame) -> DataFrame:
    """The distinct terms (of column `term`), in lower case; null and empty ones left out. One without a word character raises an error."""
    low = F.lower(F.col("term"))
    bad = F.when(low.rlike(r"(?U)\w"), low).otherwise(F.raise_error(F.format_string("no word in the term '%s'", low)).cast("string"))
    return terms.where("term is not null and term <> ''").select(bad.alias("term")).distinct()


def by_automaton(df: DataFrame, column: str, keys: list[str], terms: list[str]) -> DataFrame:
    """keys, term, start, end of what a few terms match."""
    held = df.sparkSession.sparkContext.broadcast(terms)
    rows = df.select(*keys, F.col(column).alias("_text"))
    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, word = ahocorasick.Automaton(), re.compile(r"\w")
        for t in held.value:
            machine.add_word(t, t)
        machine.make_automaton()
        for b in batches:
            at, found = [], {"term": [], "start": [], "end": []}
            for k, text in enumerate(b.column(len(keys)).to_pylist()):
                if not text:
                    continue
                low = text.lower()
                if len(low) != len(text):  # a character whose lower case is longer
                    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
                for last, t in machine.iter(low) if held.value else ():
                    start, end = last - len(t) + 1, last + 1
                    if not (start and word.match(text[start - 1])) and not (end < len(text) and word.match(text[end])):
                        at.append(k)
                        found["term"].append(t)
                        found["start"].append(start)
                        found["end"].append(end)
            picked = [c.take(pa.array(at, pa.int64())) for c in b.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(found["term"], pa.string()), pa.array(found["start"], pa.int32()), pa.array(found["end"], pa.int32())], [*keys, "term", "start", "end"])

    return rows.mapInArrow(run, f"{kind}, term string, start int, end int")


def by_first_words(df: DataFrame, column: str, keys: list[str], terms: DataFrame) -> DataFrame:
    """keys, term, start, end of what any number of terms of at most SHORT characters match.

    Texts are cut into pieces, each with one character before it and, behind it, as many as the longest term has and one more. At each
    place of a piece where a term may begin, the first two words (for terms of one word, the first) are looked up by a hash among
    those of the terms; where they are one's, the rest of the piece is compared with the whole terms. So lists whose words are counted
    few find all where the texts are; for longer ones the places are shuffled whose hash is in a map of all terms.
    """
    unicode = lambda pattern: F.lit("(?sU)" + pattern)
    n = F.regexp_count("term", unicode(WORD))
    size = terms.agg(F.sum(n).alias("n"), F.sum(n * F.length("term")).alias("size"), F.max(F.length("term")).alias("longest"), F.min(n).alias("least"), F.max(n).alias("most"), F.max(F.col("term").rlike(r"(?U)^\W")).alias("leads")).first()
    longest, one, two = size.longest or 0, (size.least or 1) == 1, (size.most or 1) > 1
    place = r"(?:\w++\W?|\W)" if size.leads else r"\w++\W*+"  # from one place where a term may begin to the next
    words = (r"\W*+" if size.leads else "") + r"\w++" + (r"(?:\W++\w++)?+" if one and two else r"\W++\w++" if two else "")

    def mark(head: Column, of: int) -> Column:  # the lower case of a sigma depends on what follows
        return F.xxhash64(F.lit(of), F.replace(F.lower(head), F.lit("ς"), F.lit("σ")))

    first = lambda c: F.regexp_extract(c, r"(?U)^\W*+\w++", 0)
    marks = [mark(first("_head") if two else F.col("_head"), 1)] * one + [mark(F.col("_head"), 2)] * two
    parts = F.regexp_extract_all(F.concat(F.lit(" "), F.col(column)), F.lit(f"(?s)(?=(.{{1,{PIECE + longest + 1}}})).{{1,{PIECE}}}"), F.lit(1))
    pieces = df.select(*keys, F.posexplode_outer(parts).alias("_k", "_piece")).where("_piece is not null")
    heads = pieces.select(*keys, "_k", "_piece", F.posexplode_outer(F.regexp_extract_all("_piece", unicode(f"(?=({words})){place}"), F.lit(1))).alias("_i", "_head")).where("_head is not null")
    heads = heads.select(*keys, "_k", "_piece", "_i", F.explode_outer(F.array_distinct(F.array(*marks))).alias("_mark") if one and two else marks[0].alias("_mark"))

    held = terms.select("term", F.length("term").alias("_size"), F.when(n == 1, mark(first("term"), 1)).otherwise(mark(F.regexp_extract("term", r"(?U)^\W*+\w++\W++\w++", 0), 2)).alias("_mark"))
    near = (size.n or 0) <= WORDS and (size["size"] or 0) <= HELD
    if near:
        there = heads.join(F.broadcast(held.select("_mark").distinct()), "_mark", "left_semi")
    else:
        bit = F.pmod("_mark", F.lit(BITS)) + 1
        maps = held.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_map"))
        at = F.bitmap_bit_position(bit).cast("int")
        byte = F.conv(F.hex(F.substring("_map", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
        there = heads.join(F.broadcast(maps), F.bitmap_bucket_number(bit) == F.col("_bucket")).where(F.getbit(byte, at.bitwiseAND(7)) == 1)
    rest = F.array_join(F.slice(F.regexp_extract_all("_piece", unicode(place), F.lit(0)), F.col("_i") + 1, F.length("_piece")), "")
    begun = there.select(*keys, "_mark", "_k", F.length("_piece").alias("_n"), F.explode_outer(F.array(rest)).alias("_rest")).withColumn("_at", F.col("_n") - F.length("_rest")).where(F.col("_at").between(1, PIECE))
    begun = begun.select(*keys, "_mark", (F.col("_k") * PIECE + F.col("_at") - 1).alias("start"), F.substring("_rest", 1, longest + 1).alias("_rest"))
    same = F.lower(F.substring("_rest", F.lit(1), F.col("_size"))) == F.col("term")
    apart = ~F.substring("_rest", F.col("_size") + 1, F.lit(1)).rlike(r"(?U)\w")
    return begun.join(F.broadcast(held) if near else held, "_mark").where(same & apart).select(*keys, "term", "start", (F.col("start") + F.col("_size")).alias("end"))


def compared(df: DataFrame, column: str, keys: list[str], met: DataFrame) -> DataFrame:
    """keys, term, start, end of those candidates (column `c` of met: term, start) that are whole terms: gathered and compared with the texts."""
    gathered = met.groupBy(*keys).agg(F.collect_list("c").alias("_candidates"))
    same = None
    for k in keys:
        this = F.col(f"t.{k}").eqNullSafe(F.col(f"g.{k}"))
        same = this if same is None else same & this
    rows = df.select(*keys, F.col(column).alias("_text")).alias("t").join(gathered.alias("g"), same)

    def kept(text: Column, found: Column) -> Column:
        def stands(paged: Column, n: Column, c: Column) -> Column:
            end = c["start"] + F.length(c["term"])
            one = lambda at: F.when((at >= 0) & (at < n), cut(paged, at, at + 1)).otherwise("").rlike(r"(?U)\w")
            return (c["start"] >= 0) & (end <= n) & (F.lower(cut(paged, c["start"], end)) == c["term"]) & ~one(c["start"] - 1) & ~one(end)

        return let(pages(text), lambda p: let(F.length(text), lambda n: F.filter(found, lambda c: F.when((c["start"] >= 0) & (c["start"] + F.length(c["term"]) <= n), stands(p, n, c)).otherwise(False))))

    found = rows.select(*[F.col(f"t.{k}").alias(k) for k in keys], F.explode_outer(kept(F.col("_text"), F.col("_candidates"))).alias("c"))  # explode() would make them twice, to leave out empty ones
    return found.where("c is not null").select(*keys, "c.term", "c.start", (F.col("c.start") + F.length("c.term")).alias("end"))


def by_rare_word(df: DataFrame, column: str, keys: list[str], terms: DataFrame) -> DataFrame:
    """keys, term, start, end of what any number of terms match; keys tell rows apart.

    The words of texts are counted without their places, and shuffled only if a term has them as its rarest; then a text's candidates are gathered, which
    its length bounds, and compared in place. Lists whose words are counted few meet the texts' words where these are.
    """
    words = df.select(*keys, F.explode_outer(tokens(F.col(column), WORD)).alias("w")).where("w is not null").select(*keys, F.col("w.word").alias("word"), F.col("w.start").alias("at"))
    parts = terms.select("term", F.explode(tokens(F.col("term"), WORD)).alias("w")).select("term", F.col("w.word").alias("word"), F.col("w.start").alias("off"))
    size = parts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("size")).first()
    near = F.broadcast if size.n <= WORDS and (size["size"] or 0) <= HELD else lambda side: side
    plain = df.select(F.explode(F.transform(F.regexp_extract_all(F.col(column), F.lit("(?U)" + WORD), F.lit(0)), F.lower)).alias("word"))
    often = plain.join(near(parts.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy("n", "off"))
    rare = parts.join(often, "word").withColumn("rank", rank).where("rank = 1")  # a term with a word that no text has matches none
    many = parts.groupBy("term").agg(F.count_distinct("word").alias("of"))
    there = parts.join(often, "word").groupBy("term").agg(F.count_distinct("word").alias("has"))
    whole = many.join(there, "term").where("of = has").select("term")
    anchors = rare.join(whole, "term", "left_semi").select("word", "term", "off")
    met = words.join(near(anchors), "word").select(*keys, F.struct("term", (F.col("at") - F.col("off")).alias("start")).alias("c"))
    return compared(df, column, keys, met)


def by_beginning(df: DataFrame, column: str, keys: list[str], terms: DataFrame) -> DataFrame:
    """keys, term, start, end of what terms of any length match: those of more than SHORT characters are looked for by as many of their
    first words as fit, and compared whole where these are found; if the first one doesn't fit, by their rarest word."""
    head = F.when(F.length("term") <= SHORT, F.col("term")).otherwise(F.regexp_extract("term", rf"(?sU)^.{{0,{SHORT - 1}}}[\w&&[^σς]](?!\w)", 0))  # a sigma's lower case depends on what follows
    heads = terms.select("term", head.alias("_head"))
    places = by_first_words(df, column, keys, heads.where("_head <> ''").select(F.col("_head").alias("term")).distinct())
    met = places.select(*keys, F.col("term").alias("_head"), "start").join(heads, "_head")
    whole = compared(df, column, keys, met.where(F.length("term") > SHORT).select(*keys, F.struct("term", "start").alias("c")))
    found = met.where(F.length("term") <= SHORT).select(*keys, "term", "start", (F.col("start") + F.length("term")).alias("end")).unionByName(whole)
    rest = heads.where("_head = ''").select("term")
    return found if rest.isEmpty() else found.unionByName(by_rare_word(df, column, keys, rest))


def list_findings(df: DataFrame, column: str, keys: list[str], terms: DataFrame, entity: str, score: float = 1.0, few: int = TERMS) -> DataFrame:
    """keys, entity_type, start, end, score, term: every place of a term (column `term` of terms) in any case, between characters
    that are of no word, or the text's ends. Terms in and over each other are all found.

    keys must tell the rows of df apart. Null and empty texts and terms match nothing; terms that repeat count once.
    """
    ready = listed(terms)
    size = ready.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("size"), F.max(F.length("term")).alias("longest")).first()
    if size.n <= few and (size["size"] or 0) <= CHARACTERS:
        found = by_automaton(df, column, keys, [r.term for r in ready.collect()])
    else:
        found = by_beginning(df, column, keys, ready) if (size.longest or 0) > SHORT else by_first_words(df, column, keys, ready)
    return found.select(*keys, F.lit(entity).alias("entity_type"), "start", "end", F.lit(float(score)).alias("score"), "term")


def without_allowed(found: DataFrame, allowed: DataFrame, any_case: bool = False) -> DataFrame:
    """Rows of findings (column `found`) whose text is not among the allowed ones (column `term`)."""
    key = (lambda c: F.lower(c)) if any_case else (lambda c: c)
    terms = allowed.select(key(F.col("term")).alias("_term")).where("_term is not null").distinct()
    return found.join(terms, key(found["found"]) == terms["_term"], "left_anti")
