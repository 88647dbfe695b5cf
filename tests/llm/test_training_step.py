"""A step of the training reads each id once, though windows overlap, and has the loss and gradients of its windows."""

import numpy as np
import pytest

from bendscape.llm import attention_lm
from bendscape.llm.attention_lm import BEFORE, BLOCK, CELLS

SIZE = 16


def some_texts(rng, n=90, ids=3000):
    lengths = np.concatenate([[0, 0, 1, BLOCK - 2, BLOCK - 1, BLOCK, 700], rng.integers(0, 60, n)])
    return rng.integers(0, ids - 1, lengths.sum()), np.append(0, np.cumsum(lengths))


def a_model(rng, ids=3000):
    m = attention_lm.Model(rng.integers(0, 50, ids).astype(float))
    m.follow(rng.integers(0, 3, (BEFORE, CELLS)).astype(float))
    for k in m.w:
        m.w[k] += rng.normal(0, 0.3, m.w[k].shape).astype(np.float32)
    return m


def windows_in(grid):
    """2 * BLOCK ids and the one behind them, of each row whose first id is not dead."""
    after = np.append(grid[1:, 0], -1)
    return [np.concatenate([grid[r - 1], grid[r], after[r : r + 1]]) for r in np.flatnonzero(grid[:, 0] >= 0)]


def test_steps_have_all_windows_and_read_each_id_once():
    rng = np.random.default_rng(1)
    m = a_model(rng)
    grid, begin = attention_lm.laid_out(*some_texts(rng), 2999)
    steps = list(attention_lm.steps_of([grid], m.cell, SIZE))
    windows = windows_in(grid)
    assert [s.windows for s in steps] == [SIZE] * (len(windows) // SIZE) + [len(windows) % SIZE] * (len(windows) % SIZE > 0)
    flat = grid.ravel()
    assert sum(len(s.at) for s in steps) == ((flat[:-1] >= 0) & (flat[1:] >= 0)).sum()
    # One row more for each step and each text; windows by themselves have two rows each.
    assert sum(len(s.cells) for s in steps) <= BLOCK * (len(windows) + len(steps) + len(begin))


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_steps_do_not_depend_on_where_grids_end(most):
    rng = np.random.default_rng(2)
    m = a_model(rng)
    grid, begin = attention_lm.laid_out(*some_texts(rng), 2999)
    whole = list(attention_lm.steps_of([grid], m.cell, SIZE))
    cut = list(attention_lm.steps_of(np.split(grid, begin[1:]), m.cell, SIZE, most))
    assert len(whole) == len(cut) > 10
    for a, b in zip(whole, cut, strict=True):
        assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in a.__dataclass_fields__)
    assert list(attention_lm.steps_of([], m.cell, SIZE)) == []


def test_a_step_has_the_loss_and_gradients_of_its_windows():
    rng = np.random.default_rng(3)
    m = a_model(rng)
    grid, _ = attention_lm.laid_out(*some_texts(rng), 2999)
    windows = windows_in(grid)
    grad = {k: np.empty_like(v) for k, v in m.w.items()}
    room = attention_lm.Room(2 * SIZE + 1, np.dtype(np.float32))
    for i, step in enumerate(attention_lm.steps_of([grid], m.cell, SIZE)):
        loss = m.backward(step, room, grad)
        ids = np.stack(windows[i * SIZE : (i + 1) * SIZE])
        cells = np.where(ids >= 0, m.cell[ids], CELLS)
        by_windows, expected = m.gradients(cells)
        assert loss == pytest.approx(by_windows, rel=1e-5) == pytest.approx(plain_loss(m, cells), rel=1e-4)
        for k, g in expected.items():
            assert np.allclose(grad[k], g, atol=1e-4 * np.abs(g).max() + 1e-9), k


def plain_loss(m, cells):
    """The mean loss, target by target."""
    e = m.w["E"][cells[:, :-1]]
    dead = np.where(cells[:, :-1] == CELLS, np.float32(-1e9), np.float32(0))
    h, _ = m.hidden(e[:, BLOCK:], e[:, :BLOCK], dead)
    losses = []
    for row, states in zip(cells, h, strict=True):
        for j in range(BLOCK):
            now, goal = row[BLOCK + j], row[BLOCK + j + 1]
            if CELLS in (now, goal):
                continue
            c, p = divmod(goal, attention_lm.PLACES)
            before = min(now, BEFORE - 1)
            for x, hit in ((states[j] @ m.w["C"] + m.of_class[before], c), (states[j] @ m.w["U"][c] + m.of_place[before, c], p)):
                losses.append(np.log(np.exp(x - x.max()).sum()) + x.max() - x[hit])
    return 2 * np.mean(losses)
