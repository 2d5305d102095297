"""Attempts on one request judged by stretches: the outcomes of the rules for one attempt at a time."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd

from casemill.operators import requests
from casemill.operators.access import ROLES

STATES = [*requests.STATES, "Otra", None]
WHY = ["a long enough reason", "  short     ", None, "x" * 10]


def test_stretches_give_the_outcomes_of_single_attempts():
    rng = random.Random(5)
    start, step = requests.request_rules()
    read, judge = requests.request_runs()
    for _ in range(200):
        rows = [
            (rng.choice(STATES), rng.choice([*ROLES, "SYSTEM_ADMIN", "SYSTEM_ADMIN", "nobody", None]), rng.choice(WHY + WHY[:1] * 5),
             rng.choice([None, None, 1.0, 2.0, 3.0]))
            for _ in range(rng.randrange(1, 60))
        ]
        df = pd.DataFrame(rows, columns=["target_state", "role", "justification", "expected_version"])
        now, known = start(), []
        for r in rows:
            known.append(step(now, SimpleNamespace(**dict(zip(df.columns, r)))))
        cut = rng.randrange(len(rows) + 1)
        state, version, found = requests.INITIAL, 1, []
        for part in (df.iloc[:cut], df.iloc[cut:]):
            outcome, changes = judge(state, version, *read(part))
            places = dict((at, (s, v)) for at, s, v in changes)
            for i, number in enumerate(outcome):
                state, version = places.get(i, (state, version))
                found.append((*requests.OUTCOMES[number], state, version))
        assert found == known


def test_a_long_run_is_a_few_passes():
    read, judge = requests.request_runs()
    n = 400_000
    asked, expected = np.full(n, 1, np.int16), np.full(n, np.nan)
    asked[::7] = read(pd.DataFrame({"target_state": ["Cerrada"], "role": ["SYSTEM_ADMIN"], "justification": [WHY[0]], "expected_version": [None]}))[0][0]
    outcome, changes = judge(requests.INITIAL, 1, asked, expected)
    assert not changes and np.bincount(outcome, minlength=8).tolist() == [0, n - len(asked[::7]), 0, 0, 0, 0, len(asked[::7]), 0]
