import pytest

from loomery.template.parser import Template
from loomery.template.scope import Scope
from loomery.template.values import TemplateError, text

VARS = {
    "execute": True, "table": "T", "one": 1.0, "two": "2", "m": {"key": "42", "string": "s", "nested": {"n": 3.0}},
    "l": ["a", "b", "c", {"deep": ["thing"]}, ["x", 3.0]], "nil": None, "f": lambda *a: "called", "fail": lambda *a: (_ for _ in ()).throw(AssertionError("called")),
}


def render(source, **more):
    import copy

    return Template(source).render(Scope({**{k: v if callable(v) else copy.deepcopy(v) for k, v in VARS.items()}, **more}))


@pytest.mark.parametrize(("source", "want"), [
    ("SELECT 1", "SELECT 1"), ("a{# note #}b", "ab"), ("{# x #}{{ table }}", "T"), ("{{ m.nested.n }}|{{ m['key'] }}", "3|42"), ("{{ l[m.nested.n].deep[0] }}", "thing"),
    ("{{ x }}{% set x = 21 %}{{ x }}", "21"), ("{% set x %}in{{ one }}{% endset %}[{{ x }}]", "[in1]"), ("a  {%- if true %}  b  {% endif -%}  c", "a  b  c"),
    ("{{- table -}}  z", "Tz"), ("{{ [1, 'b',] }}", '[1, "b"]'), ("{{ {'b': 1, 'a': {'x': 2}}.a.x }}", "2"),
    ("{% for i, v in ['p', 'q'] %}{{ i }}:{{ v }}{% if not loop.last %} - {% endif %}{% endfor %}", "0:p - 1:q"),
    ("{% for k, v in {'name': 'Jo', 'age': 23}.items() %}{{ k }}={{ v }};{% endfor %}", "age=23;name=Jo;"), ("{% for k, v in m.nested %}{{ k }}{{ v }}{% endfor %}", "n3"),
    ("{% for v in l %}{{ loop.index }}{% endfor %}", "12345"), ("{% if one == 1 %}A{% elif true %}B{% else %}C{% endif %}", "A"), ("{% if one == 2 %}A{% elif two == '2' %}B{% endif %}", "B"),
    ("{% if false and fail() %}x{% else %}y{% endif %}", "y"), ("{% if true or fail() %}y{% endif %}", "y"), ("{{ true or false and false }}", "TRUE"), ("{{ not not true }}", "TRUE"),
    ("{{ 5 / 2 }}", "2.5"), ("{{ 2 + 3 * 4 + 5 }}", "19"), ("{{ 2 ** 3 ** 2 }}", "64"), ("{{ -(1 + 2) * 3 }}", "-9"), ("{{ 8 - 3 - 2 }}", "3"), ("{{ two + 1 }}", "3"), ("{{ 10 / 4 * 2 }}", "5"),
    ("{{ 'a' ~ 1 ~ true }}", "a1TRUE"), ("{% if nothing is defined %}x{% else %}y{% endif %}", "y"), ("{% if m.absent is not defined and nil is none %}y{% endif %}", "y"),
    ("{{ 'it\\'s' }}{{ \"q\\\"\" }}", "it'sq\""), ("{{ '''a'b''' }}", "a'b"), ("{{ '' }}|", "|"), ("{{ 'b' in l }}{{ 'key' in m }}{{ 'x' in 'axe' }}{{ 9 not in [1] }}", "TRUETRUETRUETRUE"),
    ("{{ 'y' if 3 > 2 else 'n' }}", "y"), ("{{ 1 == '1' }}{{ [1, [2]] == [1, [2]] }}{{ null == none }}", "FALSETRUEFALSE"), ("{% do l.append('z') %}{{ l[5] }}", "z"), ("{{ 'ab'.upper() }}{{ 'AB'.lower() }}", "ABab"),
    ("{% macro f(a, b=2) %}<{{ a }},{{ b }}>{% endmacro %}{{ f(1) }}{{ f(a=3, b=4) }}", "<1,2><3,4>"), ("{% macro f() %}{{ caller() }}!{% endmacro %}{% call f() %}{{ table }}{% endcall %}", "T!"),
    ("{% macro f() %}{{ varargs | f2 }}{{ kwargs.z }}{% endmacro %}{{ f(1, z=7) }}", "17"), ("{% materialization x, adapter='q' %}{{ junk }}{% endmaterialization %}k", "k"),
    ("{% set x = 1 %}{% if true %}{% set x = 2 %}{% endif %}{{ x }}", "2"), ("{% set x = 1 %}{% for i in [1] %}{% set x = 2 %}{% endfor %}{{ x }}", "1"), ("{{ m.get('zz', 'd') }}{{ m.get('key') }}", "d42"),
    ("{{ TRUE }}{{ None }}{{ 1000000000000000000000 }}{{ 0.000001 }}", "TRUE10000000000000000000000.000001"),
])
def test_renders(source, want):
    assert render(source, f2=lambda v: text(len(v))) == want


@pytest.mark.parametrize(("yes", "no"), [
    ("true is boolean", "1 is boolean"), ("f is callable", "1 is callable"), ("one is defined", "zz is defined"), ("9 is divisibleby(3)", "9 is divisibleby(2)"), ("1 is eq(1)", "1 is eq '1'"), ("2 is even", "1 is even"),
    ("false is FALSE", "true is FALSE"), ("1.5 is float", "1 is float"), ("2 is ge(2)", "1 is ge(2)"), ("2 is gt 1", "1 is gt 1"), ("'a' is in(l)", "'q' is in(l)"), ("2 is integer", "2.5 is integer"), ("m is iterable", "1 is iterable"),
    ("1 is le(1)", "2 is le(1)"), ("'abc' is lower", "'aBc' is lower"), ("1 is lt(2)", "2 is lt(2)"), ("m is mapping", "l is mapping"), ("1 is ne(2)", "1 is ne(1)"), ("nil is None", "one is None"), ("1 is number", "'1' is number"),
    ("1 is odd", "2 is odd"), ("m is sameas(m)", "m is sameas(l)"), ("l is sequence", "'s' is sequence"), ("'s' is string", "1 is string"), ("true is TRUE", "false is TRUE"), ("zz is undefined", "one is undefined"), ("'ABC' is upper", "'AbC' is upper"),
    ("3 is greaterthan(2)", "3 is lessthan(2)"), ("1 is equalto(1)", "1 is not equalto(1)"),
])
def test_is(yes, no):
    assert render("{% if " + yes + " %}P{% endif %}") == "P"
    assert render("{% if " + no + " %}P{% else %}F{% endif %}") == "F"


@pytest.mark.parametrize("source", ["{% nope %}", "{{ 1", "{% if true %}", "{{ l[99] }}", "{{ 'x' - 1 }}", "{% for x in 3 %}{% endfor %}", "{% macro f(a=1, b) %}{% endmacro %}", "{{ one.x.y }}", "{{ absent() }}", "{{ 1 is nonsense }}", "{# open"])
def test_errors_name_the_place(source):
    with pytest.raises(TemplateError, match=r"template:\d+:\d+|argument"):
        render(source)


def test_return_ends_a_macro():
    from loomery.functions.builtins import FUNCTIONS

    t = "{% macro f() %}before{{ return([1, 2]) }}after{% endmacro %}{{ f()[1] }}"
    assert Template(t).render(Scope(FUNCTIONS)) == "2"
