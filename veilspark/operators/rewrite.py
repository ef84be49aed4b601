"""Rewriting: spans and an operator for each entity type make the de-identified text and the list of changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compiled import compiled
from .scan import cut, let, pages, sweep
from .spans import by_place, resolve

ITEM = "array<struct<start:int,end:int,entity_type:string,text:string,operator:string,score:double>>"


@dataclass(frozen=True)
class Op:
    """An operator's name and parameters."""

    name: str
    params: dict = field(default_factory=dict, hash=False)


def _replace(text: Column, kind: Column, new_value: str | None = None) -> Column:
    return F.lit(new_value) if new_value else F.concat(F.lit("<"), kind, F.lit(">"))


def _redact(text: Column, kind: Column) -> Column:
    return F.lit("")


def _mask(text: Column, kind: Column, masking_char: str, chars_to_mask: int, from_end: bool) -> Column:
    if not isinstance(masking_char, str) or len(masking_char) > 1:
        raise ValueError("masking_char is one character")
    if isinstance(chars_to_mask, bool) or not isinstance(chars_to_mask, int) or not isinstance(from_end, bool):
        raise ValueError("chars_to_mask is a whole number and from_end true or false")
    n = F.least(F.length(text), F.lit(max(0, int(chars_to_mask))))
    rest, mask = F.length(text) - n, F.repeat(F.lit(masking_char), n)
    return F.concat(F.substring(text, F.lit(1), rest), mask) if from_end else F.concat(mask, F.substring(text, n + 1, rest))


def _hash(text: Column, kind: Column, hash_type: str = "sha256", salt: str | bytes | None = None) -> Column:
    """Digest of the text's bytes and then the salt. Without a salt each value gets random bytes of its own, so a run that is repeated gives others.

    Salts and keys are literals of the plan, so whoever reads plans or event logs can read them.
    """
    if hash_type not in ("sha256", "sha512"):
        raise ValueError("hash_type is sha256 or sha512")
    salt = salt.encode() if isinstance(salt, str) else salt
    if salt is not None and len(salt) < 16:
        raise ValueError("a salt has 16 bytes at least")
    tail = F.lit(bytearray(salt)) if salt is not None else F.encode(F.uuid(), "UTF-8")
    return F.sha2(F.concat(F.encode(text, "UTF-8"), tail), 256 if hash_type == "sha256" else 512)


def _key(key: str | bytes) -> Column:
    key = key.encode() if isinstance(key, str) else key
    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    return F.lit(bytearray(key))


def _encrypt(text: Column, kind: Column, key: str | bytes) -> Column:
    """AES-CBC with a random vector in front, URL-safe base64."""
    return F.translate(F.base64(F.aes_encrypt(F.encode(text, "UTF-8"), _key(key), F.lit("CBC"), F.lit("PKCS"))), "+/", "-_")


def _decrypt(text: Column, kind: Column, key: str | bytes) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(F.translate(text, "-_", "+/")), _key(key), F.lit("CBC"), F.lit("PKCS")), "UTF-8")


def _custom(text: Column, kind: Column, fn: Callable[[Column], Column]) -> Column:
    return fn(text).cast("string")


def _keep(text: Column, kind: Column) -> Column:
    return text


OPERATORS: dict[str, Callable[..., Column]] = {"replace": _replace, "redact": _redact, "mask": _mask, "hash": _hash, "encrypt": _encrypt, "custom": _custom, "keep": _keep}
REVERSE: dict[str, Callable[..., Column]] = {"decrypt": _decrypt, "deanonymize_keep": _keep, "custom": _custom}


def add_operator(name: str, fn: Callable[..., Column], reverse: bool = False) -> None:
    (REVERSE if reverse else OPERATORS)[name] = fn


def remove_operator(name: str, reverse: bool = False) -> None:
    if (REVERSE if reverse else OPERATORS).pop(name, None) is None:
        raise ValueError(f"no operator {name!r}")


def applied(op: Op, text: Column, kind: Column, reverse: bool = False) -> Column:
    known = REVERSE if reverse else OPERATORS
    if op.name not in known:
        raise ValueError(f"no operator {op.name!r}")
    return known[op.name](text, kind, **op.params)


def _choose(ops: dict[str, Op], default: Op | None, text: Column, kind: Column, reverse: bool) -> tuple[Column, Column]:
    value, name = (applied(default, text, kind, reverse), F.lit(default.name)) if default else (text, F.lit("keep"))
    for k, op in ops.items():
        if k != "DEFAULT":
            value, name = F.when(kind == k, applied(op, text, kind, reverse)).otherwise(value), F.when(kind == k, op.name).otherwise(name)
    return value, name


@compiled(("text", "paged", "done"))
def _built(t: Column, paged: Column, done: Column) -> Column:
    """struct(text, items) of spans with their new texts, in order."""

    def step(a: Column, x: Column) -> Column:  # place in the old text, and length of the new one
        begin = a["n"] + F.greatest(F.lit(0), x["start"] - a["at"])
        return F.struct(F.struct(F.greatest(a["at"], x["end"]).alias("at"), (begin + F.length(x["new"])).alias("n")).alias("state"), F.struct(a["at"].alias("at"), begin.alias("begin")).alias("value"))

    def joined(r: Column) -> Column:
        def item(x: Column, p: Column) -> Column:
            return F.struct(p["begin"].alias("start"), (p["begin"] + F.length(x["new"])).alias("end"), x["entity_type"].alias("entity_type"), x["new"].alias("text"), x["op"].alias("operator"), x["score"].alias("score"))

        parts = F.zip_with(done, r["out"], lambda x, p: F.concat(cut(paged, p["at"], F.greatest(p["at"], x["start"])), x["new"]))
        text = F.concat(F.array_join(parts, ""), cut(paged, r["state"]["at"], F.length(t)))
        return F.struct(text.alias("text"), F.reverse(F.zip_with(done, r["out"], item)).cast(ITEM).alias("items"))

    return let(sweep(done, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step, "struct<at:int,begin:int>"), joined)


@compiled(("text", "spans"))
def _checked(t: Column, spans: Column) -> Column:
    """The spans by place; one that doesn't fit the text raises an error."""

    def fits(s: Column, n: Column) -> Column:
        bad = (s["start"] < 0) | (s["start"] > s["end"]) | (s["end"] > n)
        return F.when(bad, F.raise_error(F.format_string("a span from %d to %d does not fit a text of %d characters", s["start"], s["end"], n)).cast("boolean")).otherwise(True)

    return by_place(let(F.length(t), lambda n: F.filter(spans, lambda s: fits(s, n))))


def rewrite(text: Column, spans: Column, ops: dict[str, Op] | None = None, reverse: bool = False) -> Column:
    """struct(text, items) for spans that are ready; items, last span first, have places in the new text.

    A span that begins before the text, ends after it or ends before its begin raises an error.

    Where spans of different types overlap in part, each operator sees its full text and both results follow each other.
    One sweep over the spans in order gathers what is kept and what is new, which are joined once.
    """
    ops = ops or {}
    default = ops.get("DEFAULT") or (None if reverse else Op("replace"))

    def one(paged: Column, s: Column) -> Column:
        value, name = _choose(ops, default, cut(paged, s["start"], s["end"]), s["entity_type"], reverse)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), value.alias("new"), name.alias("op"))

    def of(t: Column, ready: Column) -> Column:
        unchanged = F.struct(t.alias("text"), F.array().cast(ITEM).alias("items"))
        return F.when(F.size(ready) == 0, unchanged).otherwise(let(pages(t), lambda paged: let(F.transform(ready, lambda s: one(paged, s)), lambda done: _built(t, paged, done))))

    return F.when(text.isNotNull(), let(text, lambda t: let(_checked(t, spans), lambda ready: of(t, ready))))


def anonymize(text: Column, spans: Column, ops: dict[str, Op] | None = None, policy: str = "merge_similar_or_contained", merge_blanks: bool = True) -> Column:
    """struct(text, items) after conflicts between spans are resolved; default operator: replace by the entity type."""
    return rewrite(text, let(spans, lambda s: resolve(text, s, policy, merge_blanks)), ops)


def deanonymize(text: Column, items: Column, ops: dict[str, Op]) -> Column:
    """struct(text, items) with the reverse operators applied where items say that something was changed."""
    spans = F.transform(items, lambda i: F.struct(i["entity_type"].alias("entity_type"), i["start"].alias("start"), i["end"].alias("end"), i["score"].alias("score"), F.lit("").alias("recognizer")))
    return rewrite(text, spans, ops, reverse=True)


def deanonymize_list(texts: Column, items: Column, ops: dict[str, Op]) -> Column:
    """deanonymize() of each text of an array with the items at its place; a text without items stays."""
    return F.zip_with(texts, items, lambda t, i: F.when(i.isNull(), F.struct(t.alias("text"), F.array().cast(ITEM).alias("items"))).otherwise(deanonymize(t, i, ops)))


def operators(reverse: bool = False) -> list[str]:
    return sorted(REVERSE if reverse else OPERATORS)


def ops_from(entries: dict[str, dict]) -> dict[str, Op]:
    """Operators from plain dicts: entity type to {"type": name, parameters}."""
    return {kind: Op(e["type"], {k: v for k, v in e.items() if k != "type"}) for kind, e in entries.items()}
