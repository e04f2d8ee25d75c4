import itertools

import pytest
from slotwise.functions.digits import Basis
from slotwise.operators import encoding as enc
from slotwise.operators.encoding import Coded, Encoding


def _slots(encoding, base, digit):
    if base == 1:
        return set()
    if encoding is Encoding.EQUALITY:
        return {digit}
    if encoding is Encoding.RANGE:
        return set(range(digit, base - 1))
    span = enc.interval_span(base)
    return {j for j in range(enc.slot_count(encoding, base)) if j <= digit <= j + span}


def _evaluate(formula, value, basis, encoding):
    """Whether a document of ``value`` is in the set of ``formula``."""
    if isinstance(formula, enc.Nothing):
        return False
    if isinstance(formula, enc.Slots):
        if formula.component == -1:
            return True
        digits, _ = basis.digits(value)
        held = _slots(encoding, basis.base(formula.component), digits[formula.component])
        assert formula.lo >= 0 and formula.hi < enc.slot_count(encoding, basis.base(formula.component))
        return any(formula.lo <= s <= formula.hi for s in held)
    a, b = (_evaluate(x, value, basis, encoding) for x in (formula.left, formula.right))
    return {"and": a and b, "or": a or b, "andnot": a and not b, "xor": a != b}[formula.name]


@pytest.mark.parametrize("encoding", list(Encoding))
@pytest.mark.parametrize("bases", [[c] for c in range(1, 40)] + [[2, 2, 2], [3, 4], [10, 10], [5, 2, 3], [2] * 6, [1, 3]], ids=str)
def test_formulas_by_brute_force(encoding, bases):
    basis = Basis(bases)
    coded = Coded("c", encoding, basis)
    for v in range(-1, basis.product + 1):
        equal, most = coded.equals(v), coded.at_most(v)
        for x in range(basis.product):
            assert _evaluate(equal, x, basis, encoding) == (x == v)
            assert _evaluate(most, x, basis, encoding) == (x <= v)


@pytest.mark.parametrize("encoding", list(Encoding))
@pytest.mark.parametrize("base", [1, 2, 3, 4, 5, 8, 13])
def test_stored_slots(spark, encoding, base):
    rows = spark.range(base).select(enc.slots_of(encoding, base, _int("id")).alias("s"), "id").collect()
    assert all(set(r["s"]) == _slots(encoding, base, r["id"]) for r in rows)


def _int(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("int")


def test_decomposition():
    cases = [((2, 2, 2), 5, (1, 0, 1), True), ((2, 2, 2), 8, (0, 0, 0), False), ((2, 2, 2), 9, (0, 0, 1), False), ((3, 4), 11, (2, 3), True), ((3, 4), 12, (0, 0), False), ((10, 10), 42, (4, 2), True)]
    for bases, value, digits, fits in cases:
        assert Basis(bases).digits(value) == (digits, fits)
    assert Basis([3, 4]).base(1) == 4 and Basis([3, 4]).bases == (3, 4)
    assert [Basis.binary(c).bases for c in (1, 2, 3, 8, 9)] == [(2,), (2,), (2, 2), (2, 2, 2), (2, 2, 2, 2)]
    with pytest.raises(ValueError):
        Basis([])


@pytest.mark.parametrize("bases", [[2, 2, 2], [3, 4], [5, 2, 3]], ids=str)
def test_digit_columns(spark, bases):
    basis = Basis(bases)
    frame = spark.range(basis.product + 3)
    for r in frame.select("id", *(d.alias(f"d{i}") for i, d in enumerate(basis.digit_columns(frame.id))), basis.fits(frame.id).alias("ok")).collect():
        assert (tuple(r)[1:-1], r["ok"]) == basis.digits(r["id"])


def test_slot_counts():
    for base in range(2, 40):
        assert enc.slot_count(Encoding.EQUALITY, base) == base
        assert enc.slot_count(Encoding.RANGE, base) == base - 1
        assert enc.slot_count(Encoding.INTERVAL, base) == -(-base // 2)


def test_equality_reads_few_slots():
    from slotwise.operators.index import _slots as named

    for encoding, most in ((Encoding.EQUALITY, 1), (Encoding.RANGE, 2), (Encoding.INTERVAL, 2)):
        coded = Coded("c", encoding, Basis([20]))
        for v in range(20):
            assert len([s for s in named(coded.equals(v)) if s.component >= 0]) <= most
    assert list(itertools.islice(named(Coded("c", Encoding.RANGE, Basis([20])).at_most(4)), 2)) == [enc.Slots("c", 0, 4, 4)]
