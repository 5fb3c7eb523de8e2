import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crosswind.functions.kernels import OPERATORS, ScalarOperand
from crosswind.plans.compiler import check
from crosswind.plans.language import Call, CausalityError, Const, Field, ParseError, RAW_FIELDS, ValidationError, canonical, expression_hash, lookback, make_factor, parse, validate, written


def test_infix_becomes_calls():
    assert written(parse("close + volume * -2 / open")) == "add(close,divide(multiply(volume,neg(2)),open))"
    assert parse("(close)") == Field("close")
    assert parse("1.5e2") == Const(150.0)


@pytest.mark.parametrize("text", ["", "close +", "foo", "close close", "ts_mean(close,5", "close $ open", "__import__('os')", "ts_mean(,5)"])
def test_bad_text_is_refused(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["ts_lead(close,5)", "ts_delay(close,0)", "ts_delay(close,-1)", "ts_delay(close,1.5)", "ts_delay(close,volume)", "forward_return(close,1)"])
def test_looking_ahead_is_refused(text):
    with pytest.raises(CausalityError):
        validate(parse(text))


def test_arity_names_and_limits():
    for text in ("ts_mean(close)", "eval(close)", "neg(" * 9 + "close" + ")" * 9):
        with pytest.raises(ValidationError):
            validate(parse(text))


def test_numbers_where_panels_belong():
    for text in ("1 + 2", "ts_mean(3,5)", "divide(1,2)", "abs(1)", "cs_winsor(close,close)", "clip(1,0,2)"):
        with pytest.raises(ScalarOperand):
            check(parse(text))
    check(parse("clip(close,-1,1) * (2 + 3)"))


def test_commutative_arguments_and_derived_facts():
    a, b = make_factor("a", "volume + ts_mean(ts_delay(close,3),20)"), make_factor("b", "add(ts_mean(ts_delay(close,3),20),volume)")
    assert a.expression_hash == b.expression_hash and a.canonical_expression == "add(ts_mean(ts_delay(close,3),20),volume)"
    assert a.max_lookback == 23 and a.required_fields == ("close", "volume")
    assert expression_hash(parse("close - open")) != expression_hash(parse("open - close"))
    with pytest.raises(ValidationError):
        make_factor(" ", "close")


def trees():
    leaf = st.sampled_from(RAW_FIELDS).map(Field)

    def grow(below):
        def call(name):
            spec = OPERATORS[name]
            args = [st.integers(1, 60).map(lambda n: Const(float(n))) if i in spec.windows else st.floats(0, 1).map(lambda x: Const(round(x, 3))) if i in spec.scalars else below for i in range(spec.arity)]
            return st.tuples(*args).map(lambda a: Call(name, a))

        return st.sampled_from(sorted(OPERATORS)).flatmap(call)

    return st.recursive(leaf, grow, max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(trees())
def test_round_trip_and_idempotence(tree):
    assert parse(written(tree)) == tree
    once = canonical(tree)
    assert canonical(once) == once
    assert expression_hash(once) == expression_hash(tree)
    assert lookback(once) == lookback(tree)
