"""Tokens to programs. A program's nodes are functions of a scope; statements add text to the scope's output."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from .is_tests import TESTS
from .lexer import Token, lex, place
from .scope import Macro, Return, Scope
from .values import UNDEFINED, TemplateError, contains, equal, member, number, text, truth

Node = Callable[[Scope], Any]
_WORDS = {"and", "or", "not", "in", "is", "if", "else"}
_CONSTANTS = {"true": True, "false": False, "null": None, "none": UNDEFINED}


class Parser:
    def __init__(self, source: str, name: str):
        self.source, self.name, self.tokens, self.i = source, name, lex(source, name), 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, what: str, token: Token | None = None) -> TemplateError:
        return TemplateError(f"{self.name}:{place(self.source, (token or self.now).at)}: {what}")

    def take(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def is_op(self, *ops: str) -> bool:
        return self.now.kind == "op" and self.now.value in ops

    def is_word(self, *words: str) -> bool:
        return self.now.kind == "name" and self.now.value in words

    def accept(self, value: str) -> bool:
        if self.now.kind in ("op", "name") and self.now.value == value:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.accept(value):
            raise self.fail(f"{value!r} is missing before {self.now.value!r}")

    def word(self) -> str:
        if self.now.kind != "name":
            raise self.fail("a name is missing")
        return self.take().value

    def close(self) -> None:
        if self.now.kind != "close":
            raise self.fail(f"unexpected {self.now.value!r}")
        self.i += 1

    # -- statements

    def body(self, *ends: str) -> tuple[Node, str]:
        """Nodes up to one of the end tags, whose name is taken; its rest isn't."""
        nodes: list[Node] = []
        while True:
            t = self.take()
            if t.kind == "text":
                nodes.append(lambda s, x=t.value: s.out.append(x))
            elif t.kind == "end":
                if ends:
                    raise self.fail(f"{ends[-1]} is missing", t)
                return _run_all(nodes), ""
            elif t.value == "{":
                e = self.expression()
                self.close()
                nodes.append(self.guard(lambda s, e=e: s.out.append(text(e(s))), t))
            else:
                word = self.word()
                if word in ends:
                    return _run_all(nodes), word
                statement = getattr(self, f"do_{word}", None)
                if statement is None:
                    raise self.fail(f"unknown tag {word!r}", t)
                nodes.append(self.guard(statement(), t))

    def guard(self, node: Node, token: Token) -> Node:
        where = f"{self.name}:{place(self.source, token.at)}"

        def run(s: Scope) -> None:
            try:
                node(s)
            except TemplateError as e:
                if not e.args or ": " not in str(e) or not str(e).split(": ")[0].rpartition(":")[2].isdigit():
                    raise TemplateError(f"{where}: {e}") from e
                raise
            except (TypeError, ZeroDivisionError, KeyError) as e:
                raise TemplateError(f"{where}: {e}") from e

        return run

    def do_set(self) -> Node:
        name = self.word()
        if self.accept("="):
            e = self.expression()
            self.close()
            return lambda s: s.set(name, e(s))
        self.close()
        inner, _ = self.body("endset")
        self.close()
        return lambda s: s.set(name, s.capture(inner))

    def do_if(self) -> Node:
        arms: list[tuple[Node | None, Node]] = []
        condition: Node | None = self.expression()
        self.close()
        while True:
            inner, end = self.body("elif", "else", "endif")
            arms.append((condition, inner))
            if end == "endif":
                self.close()
                break
            condition = self.expression() if end == "elif" else None
            self.close()

        def run(s: Scope) -> None:
            for c, inner in arms:
                if c is None or truth(c(s)):
                    inner(s)
                    return

        return run

    def do_for(self) -> Node:
        first = self.word()
        second = self.word() if self.accept(",") else None
        self.need("in")
        over = self.expression()
        self.close()
        inner, end = self.body("else", "endfor")
        other = None
        self.close()
        if end == "else":
            other, _ = self.body("endfor")
            self.close()

        def run(s: Scope) -> None:
            items = over(s)
            if isinstance(items, dict):
                rows = [(k, items[k]) for k in sorted(items)]
            elif isinstance(items, list):
                pairs = second is not None and all(isinstance(x, list) and len(x) == 2 for x in items) and items
                rows = [tuple(x) for x in items] if pairs else [(float(i), x) for i, x in enumerate(items)]
            elif items is UNDEFINED and not s.lookup("execute"):
                rows = []  # what introspection would give isn't known in the first pass
            else:
                raise TemplateError("only lists and maps can be looped over")
            if not rows and other is not None:
                other(s)
            for i, (k, v) in enumerate(rows):
                each = s.child()
                each.vars["loop"] = {"index": float(i + 1), "index0": float(i), "first": i == 0, "last": i == len(rows) - 1, "length": float(len(rows))}
                if second is None:
                    each.vars[first] = k if isinstance(items, dict) else v
                else:
                    each.vars[first], each.vars[second] = k, v
                inner(each)

        return run

    def params(self) -> list[tuple[str, Node | None]]:
        out: list[tuple[str, Node | None]] = []
        self.need("(")
        while not self.accept(")"):
            t = self.now
            name = self.word()
            default = self.expression() if self.accept("=") else None
            if default is None and out and out[-1][1] is not None:
                raise self.fail(f"{name!r} has no default and stands after one that has", t)
            out.append((name, default))
            if not self.accept(",") and not self.is_op(")"):
                raise self.fail("',' is missing")
        return out

    def do_macro(self) -> Node:
        name, params = self.word(), self.params()
        self.close()
        inner, _ = self.body("endmacro")
        self.close()
        return lambda s: s.define(Macro(name, params, inner, self.name))

    def do_call(self) -> Node:
        t = self.now
        params = self.params() if self.is_op("(") else []
        call = self.expression(caller=True)
        if not hasattr(call, "with_caller"):
            raise self.fail("a call is missing", t)
        self.close()
        inner, _ = self.body("endcall")
        self.close()

        def run(s: Scope) -> None:
            caller = Macro("caller", params, inner, self.name, home=s)
            s.out.append(text(call.with_caller(s, caller)))

        return run

    def do_do(self) -> Node:
        e = self.expression()
        self.close()
        return lambda s: e(s)

    def do_materialization(self) -> Node:
        """A block that is read over."""
        while not (self.now.kind == "open" and self.tokens[self.i + 1].value == "endmaterialization"):
            if self.take().kind == "end":
                raise self.fail("endmaterialization is missing")
        self.i += 2
        self.close()
        return lambda s: None

    # -- expressions, from the loosest

    def expression(self, caller: bool = False) -> Node:
        e = self.any_of()
        if self.is_word("if"):
            self.take()
            c = self.any_of()
            other = self.expression() if self.accept("else") else (lambda s: UNDEFINED)
            return lambda s: e(s) if truth(c(s)) else other(s)
        return e

    def any_of(self) -> Node:
        e = self.all_of()
        while self.is_word("or"):
            self.take()
            e = (lambda a, b: lambda s: truth(a(s)) or truth(b(s)))(e, self.all_of())
        return e

    def all_of(self) -> Node:
        e = self.negation()
        while self.is_word("and"):
            self.take()
            e = (lambda a, b: lambda s: truth(a(s)) and truth(b(s)))(e, self.negation())
        return e

    def negation(self) -> Node:
        if self.is_word("not"):
            self.take()
            e = self.negation()
            return lambda s: not truth(e(s))
        return self.comparison()

    _COMPARE = {
        "==": equal,
        "!=": lambda a, b: not equal(a, b),
        "<": lambda a, b: number(a) < number(b),
        "<=": lambda a, b: number(a) <= number(b),
        ">": lambda a, b: number(a) > number(b),
        ">=": lambda a, b: number(a) >= number(b),
    }

    def comparison(self) -> Node:
        e = self.concat()
        while True:
            if self.is_op(*self._COMPARE):
                f = self._COMPARE[self.take().value]
                e = (lambda a, b, f: lambda s: f(a(s), b(s)))(e, self.concat(), f)
            elif self.is_word("in") or self.is_word("not") and self.tokens[self.i + 1].value == "in":
                negative = self.take().value == "not"
                if negative:
                    self.take()
                e = (lambda a, b, n: lambda s: contains(a(s), b(s)) != n)(e, self.concat(), negative)
            elif self.is_word("is"):
                self.take()
                e = self.is_test(e)
            else:
                return e

    def is_test(self, e: Node) -> Node:
        negative = self.accept("not")
        t = self.take()
        test = TESTS.get(t.value)
        if test is None:
            raise self.fail(f"unknown test {t.value!r}", t)
        f, has_argument = test
        if not has_argument:
            return lambda s: f(e(s)) != negative
        if self.accept("("):
            arg = self.expression()
            self.need(")")
        else:
            arg = self.concat()
        return lambda s: f(e(s), arg(s)) != negative

    def concat(self) -> Node:
        e = self.filtered()
        while self.is_op("~"):
            self.take()
            e = (lambda a, b: lambda s: text(a(s)) + text(b(s)))(e, self.filtered())
        return e

    def filtered(self) -> Node:
        e = self.sum()
        while self.is_op("|"):
            self.take()
            t = self.now
            f: Node = self.name_node(self.word(), t)
            while self.accept("."):
                f = (lambda f, k: lambda s: member(f(s), k))(f, self.word())
            args, kwargs = self.arguments() if self.is_op("(") else ([], {})
            e = self.call_node(f, [e, *args], kwargs, t.value)
        return e

    _MATHS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "**": lambda a, b: math.pow(a, b)}

    def _left(self, ops: tuple[str, ...], below: Callable[[], Node]) -> Node:
        e = below()
        while self.is_op(*ops):
            f = self._MATHS[self.take().value]
            e = (lambda a, b, f: lambda s: f(number(a(s)), number(b(s))))(e, below(), f)
        return e

    def sum(self) -> Node:
        return self._left(("+", "-"), self.product)

    def product(self) -> Node:
        return self._left(("*", "/"), self.power)

    def power(self) -> Node:
        return self._left(("**",), self.unary)

    def unary(self) -> Node:
        if self.is_op("-"):
            self.take()
            e = self.unary()
            return lambda s: -number(e(s))
        return self.postfix()

    def name_node(self, name: str, t: Token) -> Node:
        if name.lower() in _CONSTANTS:
            value = _CONSTANTS[name.lower()]
            return lambda s: value
        if name in _WORDS:
            raise self.fail(f"unexpected {name!r}", t)
        return lambda s: s.lookup(name)

    def atom(self) -> Node:
        t = self.take()
        if t.kind == "string":
            return lambda s: t.value
        if t.kind == "number":
            value = float(t.value)
            return lambda s: value
        if t.kind == "name":
            return self.name_node(t.value, t)
        if t.kind == "op" and t.value == "(":
            e = self.expression()
            self.need(")")
            return e
        if t.kind == "op" and t.value == "[":
            items = []
            while not self.accept("]"):
                items.append(self.expression())
                self.accept(",")
            return lambda s: [x(s) for x in items]
        if t.kind == "op" and t.value == "{":
            pairs = []
            while not self.accept("}"):
                k = self.expression()
                self.need(":")
                pairs.append((k, self.expression()))
                if not self.accept(",") and not self.is_op("}"):
                    raise self.fail("',' is missing")
            return lambda s: {text(k(s)): v(s) for k, v in pairs}
        raise self.fail(f"unexpected {t.value!r}", t)

    def postfix(self) -> Node:
        t = self.now
        e, name = self.atom(), t.value
        while True:
            if self.accept("."):
                name = self.word()
                e = (lambda a, k: lambda s: member(a(s), k))(e, name)
            elif self.accept("["):
                k = self.expression()
                self.need("]")
                e = (lambda a, k: lambda s: member(a(s), k(s)))(e, k)
            elif self.is_op("("):
                args, kwargs = self.arguments()
                e = self.call_node(e, args, kwargs, name)
            else:
                return e

    def arguments(self) -> tuple[list[Node], dict[str, Node]]:
        args: list[Node] = []
        kwargs: dict[str, Node] = {}
        self.need("(")
        while not self.accept(")"):
            if self.now.kind == "name" and self.tokens[self.i + 1].value == "=" and self.tokens[self.i + 1].kind == "op":
                key = self.take().value
                self.take()
                kwargs[key] = self.expression()
            else:
                if kwargs:
                    raise self.fail("an argument without name stands after one with a name")
                args.append(self.expression())
            if not self.accept(",") and not self.is_op(")"):
                raise self.fail("',' is missing")
        return args, kwargs

    def call_node(self, f: Node, args: list[Node], kwargs: dict[str, Node], name: str) -> Node:
        def call(s: Scope, caller: Macro | None = None) -> Any:
            callee = f(s)
            if not callable(callee):
                raise TemplateError(f"{name!r} isn't a function")
            a, k = [x(s) for x in args], {n: x(s) for n, x in kwargs.items()}
            if isinstance(callee, Macro):
                return callee.call(s, a, k, caller)
            out = callee(*a, **k)
            return UNDEFINED if out is None and not getattr(callee, "may_be_null", False) else out

        def node(s: Scope) -> Any:
            return call(s)

        node.with_caller = call
        return node


def _run_all(nodes: list[Node]) -> Node:
    if len(nodes) == 1:
        return nodes[0]

    def run(s: Scope) -> None:
        for n in nodes:
            n(s)

    return run


class Template:
    """A parsed template, to be rendered any number of times."""

    def __init__(self, source: str, name: str = "template"):
        self.name = name
        self.run, _ = Parser(source, name).body()

    def render(self, scope: Scope) -> str:
        """The text; what `return` gives ends it and replaces nothing that came before."""
        try:
            self.run(scope)
        except Return:
            pass
        return "".join(scope.out)
