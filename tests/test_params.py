import pytest

from driftframe.params import InputError, resolve


def test_defaults_and_units():
    p = resolve({"t_end_fit_ps": 0.1}, 2.0)
    assert (p.t_end, p.fits, p.stepsize_t, p.stepsize_tau, p.nr_of_t) == (50, ((0, 50),), 1, 1, 50)
    assert resolve({"t_end_fit_fs": 15, "t_start_fit_fs": 5}, 2.0).fits == ((2, 7),)  # scalars are truncated
    assert resolve({"t_end_fit_fs": [15, 21], "t_start_fit_fs": [5, 7]}, 2.0).fits == ((2, 8), (4, 10))  # lists are rounded half to even
    assert resolve({"t_end_fit_dt": 9, "stepsize_t": 2}, 2.0).slices() == [(0, 4)]


def test_blocks():
    p = resolve({"t_end_fit_dt": 20, "nr_of_blocks": 3}, 1.0)
    assert p.blocks(100) == (26, 3) and resolve({"t_end_fit_dt": 20}, 1.0).blocks(100) == (80, 1)
    assert resolve({"t_end_fit_dt": 20, "block_length_dt": 30}, 1.0).blocks(100) == (30, 2)
    for n in (20, 22):
        with pytest.raises(InputError):
            p.blocks(n)


def test_long_lags():
    assert resolve({"t_end_fit_dt": 5, "t_long_end_dt": 30, "stepsize_t": 4}, 1.0).long_t(100) == 7
    assert resolve({"t_end_fit_dt": 5, "t_long_factor": 0.5, "stepsize_t": 4}, 1.0).long_t(100) == 12
    assert resolve({"t_end_fit_dt": 5, "stepsize_t": 4}, 1.0).long_t(100) == 24
    with pytest.raises(InputError):
        resolve({"t_end_fit_dt": 5, "t_long_end_dt": 300}, 1.0).long_t(100)


@pytest.mark.parametrize("bad", [
    {}, {"t_end_fit_dt": 5, "t_end_fit_fs": 5}, {"t_end_fit_dt": 5, "what": 1}, {"t_end_fit_dt": 5, "t_end_dt": 4}, {"t_end_fit_dt": 5, "nr_of_blocks": 2, "block_length_dt": 3}, {"t_end_fit_dt": 5, "nr_of_blocks": 0},
    {"t_end_fit_dt": [5, 6], "t_start_fit_dt": [1]}, {"t_end_fit_dt": 5, "t_start_fit_dt": 5}, {"t_end_fit_dt": 5, "t_long_end_dt": 5, "t_long_factor": 1.0}, {"t_end_fit_dt": 5, "stepsize_t": -1},
])
def test_refused(bad):
    with pytest.raises(InputError):
        resolve(bad, 1.0)


def test_start_is_not_implemented_and_species_are_wrapped():
    with pytest.raises(NotImplementedError):
        resolve({"t_end_fit_dt": 5, "t_start_dt": 1}, 1.0)
    assert resolve({"t_end_fit_dt": 5, "species_of_interest": "Al"}, 1.0).species == ("Al",)
