"""Statements by recursive descent."""

from __future__ import annotations

import re
from typing import Any

from .lexer import StatementError, Token, tokens
from .nodes import Between, Both, Change, Classifier, Compare, Declare, Either, Explain, Finetune, Finetuned, In, IsNull, Order, Output, Print, Purge, Reader, Readers, Register, Select, Use

FUNCTIONS = ("sum", "avg", "min", "max")
#: Names that a variable can't have.
RESERVED = frozenset(("image_models", "text_models", "models", "readers", "known_results"))


class Parser:
    def __init__(self, text: str):
        self.held, self.at = tokens(text), 0

    # -- single words
    @property
    def now(self) -> Token:
        return self.held[self.at]

    def fail(self, wanted: str) -> StatementError:
        return StatementError(f"{wanted} was expected at {self.now.place}, not {self.now.value!r}")

    def take(self, *values: str) -> str | None:
        """The next word or sign if it is one of these."""
        if self.now.kind in ("keyword", "op") and self.now.value in values:
            self.at += 1
            return str(self.held[self.at - 1].value)
        return None

    def need(self, *values: str) -> str:
        got = self.take(*values)
        if got is None:
            raise self.fail(" or ".join(values))
        return got

    def name(self) -> str:
        """A name, perhaps with dots; a keyword will do where only a name can be."""
        if self.now.kind not in ("name", "keyword"):
            raise self.fail("a name")
        parts = [str(self.now.value)]
        self.at += 1
        while self.now.value == "." and self.held[self.at + 1].kind in ("name", "keyword"):
            parts.append(str(self.held[self.at + 1].value))
            self.at += 2
        return ".".join(parts)

    def text(self) -> str:
        if self.now.kind == "string":
            self.at += 1
            return str(self.held[self.at - 1].value)
        return self.name()

    def value(self) -> Any:
        if self.take("["):
            return tuple(self.listed(self.value, "]"))
        sign = -1 if self.take("-") else 1
        if self.now.kind == "number":
            self.at += 1
            return sign * self.held[self.at - 1].value
        if self.take("null"):
            return None
        return self.text()

    def listed(self, one, end: str) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        self.need(end)
        return out

    def whole(self) -> int:
        if self.now.kind != "number" or not isinstance(self.now.value, int):
            raise self.fail("a whole number")
        self.at += 1
        return int(self.held[self.at - 1].value)

    # -- statements
    def statement(self) -> Any:
        word = self.need("select", "rank", "explain", "declare", "print", "register", "finetune", "use", "purge")
        out = getattr(self, f"_{word}")()
        self.take(";")
        if self.now.kind != "end":
            raise self.fail("the end")
        return out

    def _explain(self) -> Explain:
        json = bool(self.take("json"))
        return Explain(self._select() if self.need("select", "rank") == "select" else self._rank(), json)

    def _declare(self) -> Declare:
        name = self.name()
        if name.lower() in RESERVED:
            raise StatementError(f"{name} is the name of a table")
        self.need("as")
        self.need("select")
        return Declare(name, self._select())

    def _print(self) -> Print:
        return Print(self.take("*") or self.name())

    def _register(self) -> Register:
        self.need("dataset")
        name = self.text()
        self.need("(")
        columns = self.listed(self.text, ")")
        self.need("values")
        self.need("(")
        values = self.listed(self.value, ")")
        if len(columns) != len(values):
            raise StatementError("as many values as columns are expected")
        return Register(name, tuple(columns), tuple(values))

    def _finetune(self) -> Finetune:
        models = self.names()
        self.need("with")
        out = Finetune(models, self.names())
        self.waits()
        return out

    def _use(self) -> Use:
        return Use(self.text())

    def _purge(self) -> Purge:
        return Purge()

    def names(self) -> tuple[str, ...]:
        if self.take("["):
            return tuple(self.listed(self.text, "]"))
        out = [self.text()]
        while self.take(","):
            out.append(self.text())
        return tuple(out)

    def waits(self) -> bool:
        if self.now.kind == "name" and self.now.value == "wait":
            self.at += 1
            return True
        return False

    def _select(self) -> Select:
        return self._query(False)

    def _rank(self) -> Select:
        return self._query(True)

    def _query(self, ranked: bool) -> Select:
        outputs = [self.output()]
        while self.take(","):
            outputs.append(self.output())
        self.need("from")
        held: dict[str, Any] = {"outputs": tuple(outputs), "source": self.text()}
        if self.take("where"):
            held["where"] = self.either()
        if self.take("order"):
            self.need("by")
            held["order"] = self.order()
        if self.take("trained"):
            self.need("on")
            held["trained"] = self.readers()
        if self.take("tested"):
            self.need("on")
            held["tested"] = self.readers()
        if ranked:
            self.need("by")
            held["by"], held["params"] = self.extension()
        elif self.take("classified"):
            self.need("by")
            held["classifiers"] = self.classifiers()
        if self.take("limit"):
            held["limit"] = self.whole()
        if not ranked:
            if self.take("other"):
                self.need("than")
                held["other_than"] = self.name()
            for word in ("chunk", "budget"):
                if self.take(word):
                    held[word] = self.take("auto") or self.whole()
        held["wait"] = self.waits()
        return Select(**held)

    def output(self) -> Output:
        if self.take("*"):
            return Output("*")
        distinct = bool(self.take("distinct"))
        name = self.text()
        alias = self.text() if self.take("as") or self.now.kind in ("name", "string") and self.now.value != "wait" else None
        return Output(name, alias, distinct)

    def either(self) -> Any:
        parts = [self.both()]
        while self.take("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both(self) -> Any:
        parts = [self.condition()]
        while self.take("and"):
            parts.append(self.condition())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def condition(self) -> Any:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.take("not"):
            self.need("finetuned")
            return Finetuned(True)
        if self.take("finetuned"):
            return Finetuned(False)
        column = self.text()
        if self.take("between"):
            low = self.value()
            self.need("and")
            return Between(column, low, self.value())
        outside = bool(self.take("not"))
        if outside or self.now.value == "in":
            self.need("in")
            return In(column, tuple(self.listed(self.value, ")" if self.need("(", "[") == "(" else "]")), outside)
        if self.take("is"):
            negated = bool(self.take("not"))
            self.need("null")
            return IsNull(column, negated)
        op = self.need("=", "==", "!=", "<>", "<", "<=", ">", ">=")
        return Compare(column, {"==": "=", "<>": "!="}.get(op, op), self.value())

    def order(self) -> Order:
        key, function = self.text(), None
        if self.take("("):
            if key.lower() not in FUNCTIONS:
                raise StatementError(f"no such function: {key}")
            function, key = key.lower(), self.text()
            self.need(")")
        return Order(key, self.take("asc", "desc") == "desc", function)

    def readers(self) -> Readers:
        benchmark = self.take("benchmark", "task") == "benchmark"
        if self.take("["):
            return Readers(tuple(self.listed(self.reader, "]")), benchmark)
        out = [self.reader()]
        while self.take(","):
            out.append(self.reader())
        return Readers(tuple(out), benchmark)

    def reader(self) -> Reader:
        if not self.take("("):
            return Reader(self.text())
        name, changes = self.text(), [self.change()]
        while self.take(","):
            changes.append(self.change())
        self.need(")")
        return Reader(name, tuple(changes))

    def change(self) -> Change:
        self.need("change")
        self.need("[")
        base = self.listed(self.whole, "]")
        self.need("to")
        name = self.text()
        self.need("[")
        return Change(tuple(base), name, tuple(self.listed(self.whole, "]")))

    def classifiers(self) -> tuple[Classifier, ...]:
        self.need("[")
        out = self.listed(self.classifier, "]")
        if len({c.value for c in out}) < len(out):
            raise StatementError("a classifier is named twice")
        return tuple(out)

    def classifier(self) -> Classifier:
        name, params = self.text(), []
        if self.take("("):
            params = self.listed(self.param, ")")
        return Classifier(name, tuple(params))

    def param(self) -> tuple[str, Any]:
        key = self.name()
        self.need("=")
        return key, self.value()

    def extension(self) -> tuple[str, dict[str, Any]]:
        """A name, perhaps with parameters in brackets within the string."""
        text = self.text()
        m = re.fullmatch(r"\s*([A-Za-z]\w*)\s*(?:\((.*)\))?\s*", text)
        if not m:
            raise StatementError(f"no such extension: {text}")
        if not (m[2] or "").strip():
            return m[1], {}
        inner = Parser(f"{m[2]})")
        return m[1], dict(inner.listed(inner.param, ")"))


def parse(text: str) -> Any:
    return Parser(text).statement()


def statements(text: str) -> list[Any]:
    """One statement a line; lines that begin with # are remarks."""
    return [parse(line) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
