import math

from helpers import one
from parcelwise.plans import repeat

SCHEMA = "is_eligible boolean, returned_in_window boolean, is_late boolean, customer_state string"


def people(state, late, returned, n, eligible=True):
    return [(eligible, returned, late, state)] * n


ROWS = [
    *people("SP", True, True, 5),
    *people("SP", True, False, 25),
    *people("SP", False, True, 30),
    *people("SP", False, False, 70),
    *people("RJ", True, True, 2),
    *people("RJ", True, False, 18),
    *people("RJ", False, True, 10),
    *people("RJ", False, False, 30),
    # Too few late first orders.
    *people("BA", True, True, 19),
    # Unknown lateness counts for nothing but the total.
    *people("SP", None, True, 3),
    *people("SP", True, True, 50, eligible=False),
]


def test_summary(frame):
    found = one(repeat.repeat_summary(frame(SCHEMA, *ROWS)))
    late, late_returned = 30 + 20 + 19, 5 + 2 + 19
    assert (found["eligible_customers"], found["returned"], found["late_first_orders"]) == (212, 69, late)
    assert abs(found["repeat_if_late"] - late_returned / late) < 1e-12
    assert abs(found["repeat_if_on_time"] - 40 / 140) < 1e-12


def test_standardised(frame):
    found = one(repeat.state_standardised_repeat(frame(SCHEMA, *ROWS)))
    late = (5 + 2) / 50
    on_time = (0.3 * 30 + 0.25 * 20) / 50
    assert found["n_late"] == 50
    assert abs(found["late"] - late) < 1e-9 and abs(found["on_time_standardised"] - on_time) < 1e-9
    assert abs(found["z"] - (late - on_time) / math.sqrt(on_time * (1 - on_time) / 50)) < 1e-5
