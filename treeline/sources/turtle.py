"""Turtle (RDF): a table function from text to triples, and accessors."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "subject string, predicate string, object string, kind string, lang string, datatype string"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)'
    r"|(?P<type>\^\^)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w-]+)|(?P<name>[\w-]*:[\w.%-]*[\w%-]|[\w-]*:|[A-Za-z]+)|(?P<mark>[.;,\[\]()])",
    re.S,
)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "'": "'", '"': '"', "\\": "\\"}


def _plain(text: str) -> str:
    """A literal without escapes; unknown ones are an error."""

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPE:
            raise ValueError(f"unknown escape \\{m[2]}")
        return _ESCAPE[m[2]]

    return re.sub(r"\\(?:(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|(.))", one, text, flags=re.S)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable at {at}: {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.t, self.i, self.prefix, self.blank, self.rows = _tokens(text), 0, {}, 0, []

    def look(self) -> tuple[str, str]:
        return self.t[self.i] if self.i < len(self.t) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.look()
        if value is not None and token[1] != value:
            raise ValueError(f"expected {value!r}, found {token[1]!r}")
        self.i += 1
        return token

    def document(self) -> list[tuple]:
        while self.look()[0] != "end":
            kind, value = self.look()
            if value.lower() in ("@prefix", "prefix", "@base", "base"):
                self.take()
                name = self.take()[1] if "prefix" in value.lower() else ":base"
                self.prefix[name[:-1] if name != ":base" else name] = self.take()[1][1:-1]
                if value[0] == "@":
                    self.take(".")
            else:
                self.predicates(self.term()[0])
                self.take(".")
        return self.rows

    def predicates(self, subject: str) -> None:
        while self.look()[1] not in (".", "]"):
            predicate = TYPE if self.look() == ("name", "a") and self.take() else self.term()[0]
            while True:
                self.rows.append((subject, predicate, *self.term()))
                if self.look()[1] != ",":
                    break
                self.take()
            while self.look()[1] == ";":
                self.take()

    def iri(self, kind: str, value: str) -> str:
        if kind == "iri":
            return (self.prefix.get(":base", "") if ":" not in value else "") + value[1:-1]
        name, _, local = value.partition(":")
        return self.prefix[name] + local

    def term(self) -> tuple[str, str, str | None, str | None]:
        """(value, kind, lang, datatype)."""
        kind, value = self.take()
        if value == "[":
            self.blank += 1
            node = f"_:b{self.blank}"
            self.predicates(node)
            self.take("]")
            return node, "blank", None, None
        if value == "(":
            items = []
            while self.look()[1] != ")":
                items.append(self.term()[0])
            self.take()
            return " ".join(items), "list", None, None
        if kind in ("text", "long"):
            body = _plain(value[3:-3] if kind == "long" else value[1:-1])
            if self.look()[0] == "lang":
                return body, "literal", self.take()[1][1:], None
            if self.look()[0] == "type":
                self.take()
                return body, "literal", None, self.iri(*self.take())
            return body, "literal", None, None
        if kind == "num":
            return value, "number", None, None
        if kind == "blank":
            return value, "blank", None, None
        if kind == "name" and value in ("true", "false"):
            return value, "boolean", None, None
        return self.iri(kind, value), "iri", None, None


def parse(text: str) -> Iterator[tuple]:
    yield from _Parser(text).document()


class TurtleReader:
    def eval(self, text: str):
        yield from parse(text)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("turtle", udtf(TurtleReader, returnType=SCHEMA))


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    spark.read.text(path, wholetext=True).createOrReplaceTempView("_turtle_text")
    return spark.sql("SELECT t.* FROM _turtle_text, LATERAL turtle(value) t")


def one(triples: DataFrame, predicate: str, name: str, lang: str | None = None) -> DataFrame:
    """(subject, name): the least object of a predicate, in a language if asked for."""
    some = triples.where(F.col("predicate") == predicate)
    some = some.where(F.col("lang") == lang) if lang else some
    return some.groupBy("subject").agg(F.min("object").alias(name))


def local(iri):
    """What follows the last slash or hash."""
    return F.regexp_extract(iri, "([^/#]*)$", 1)


def bounds(triples: DataFrame, predicate: str, value: str, error: str, name: str) -> DataFrame:
    """(subject, name, name_error) through a blank node that holds value and error."""
    link = triples.where(F.col("predicate") == predicate).select("subject", F.col("object").alias("node"))
    v = one(triples, value, name).select(F.col("subject").alias("node"), F.expr(f"try_cast({name} AS DOUBLE)").alias(name))
    e = one(triples, error, f"{name}_error").select(F.col("subject").alias("node"), F.expr(f"try_cast({name}_error AS DOUBLE)").alias(f"{name}_error"))
    return link.join(v, "node", "left").join(e, "node", "left").drop("node")
