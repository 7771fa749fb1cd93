"""The array namespace against NumPy on small arrays."""

import numpy as np
import pytest

import coordframe as cf

pytestmark = pytest.mark.usefixtures("spark")

A = np.array([[1, 0, 3], [0, -2, 4]])
B = np.array([[0, 5, 3], [7, 0, -4]])
X = np.array([[4.0, 1.0, 1.0], [2.0, 2.0, 3.0]])
SPECIAL = np.array([0.0, -0.0, 1.0, -1.0, 2.5, -7.5, 3.0, np.inf, -np.inf, np.nan])


def check(got, want, rtol=1e-12):
    got = got.to_numpy() if hasattr(got, "to_numpy") else got
    want = np.asarray(want)
    assert got.shape == want.shape, (got.shape, want.shape)
    np.testing.assert_allclose(got, want, rtol=rtol, atol=1e-12 if want.dtype.kind in "fc" else 0)


@pytest.mark.parametrize("fill", [0, 1, 7])
@pytest.mark.parametrize("name", ["add", "subtract", "multiply", "maximum", "minimum", "equal", "less", "bitwise_xor", "floor_divide", "mod"])
def test_binary_integers(name, fill):
    b = np.where(B == 0, 2, B)
    host = {"floor_divide": np.floor_divide, "mod": np.mod}.get(name) or getattr(np, name)
    got = getattr(cf, name)(cf.from_numpy(A, fill), cf.from_numpy(b, 3))
    check(got, host(A, b))
    assert got.dtype == host(A, b).dtype


def test_binary_specials_in_one_plan():
    a, b = np.meshgrid(SPECIAL, SPECIAL, indexing="ij")
    ta, tb = cf.asarray(a), cf.asarray(b)
    with np.errstate(all="ignore"):
        for name, host in (("divide", np.divide), ("hypot", np.hypot), ("maximum", np.maximum), ("copysign", np.copysign), ("less", np.less), ("not_equal", np.not_equal), ("atan2", np.arctan2), ("power", np.power), ("mod", np.mod)):
            check(getattr(cf, name)(ta, tb), host(a, b))


def test_floor_divide_keeps_infinities():
    got = cf.floor_divide(cf.asarray(np.array([np.inf, -np.inf, 1.0, 1.0])), cf.asarray(np.array([1.0, 1.0, -np.inf, -2.0]))).to_numpy()
    np.testing.assert_array_equal(got, [np.inf, -np.inf, -0.0, -1.0])
    assert np.signbit(got[2])


def test_unary_specials():
    t = cf.asarray(SPECIAL)
    with np.errstate(all="ignore"):
        for name in "sqrt exp expm1 log log1p log2 log10 sin tanh floor ceil trunc round sign isnan isinf isfinite signbit abs negative square".split():
            check(getattr(cf, name)(t), getattr(np, {"abs": "abs"}.get(name, name))(SPECIAL))


def test_wrap_around_and_promotion():
    a = cf.asarray(np.array([120, -128], dtype="int8"))
    check(a + a, np.array([120, -128], dtype="int8") * np.int8(2))
    assert (cf.asarray(np.ones(2, "float32")) + 1.0).dtype == np.float32
    check(cf.astype(cf.asarray(np.array([300, -1])), "uint8"), np.array([44, 255], dtype="uint8"))
    check(cf.sum(cf.asarray(np.array([200, 100], dtype="uint8"))), np.uint64(300))


def test_broadcasting():
    check(cf.asarray(A) + cf.asarray(np.array([10, 0, 30])), A + [10, 0, 30])
    check(cf.asarray(A[:, :1]) * cf.asarray(B), A[:, :1] * B)
    check(cf.asarray(np.arange(3)[:, None]) + cf.asarray(np.arange(4)[None]), np.add.outer(np.arange(3), np.arange(4)))
    check(cf.where(cf.asarray(A) > 0, cf.asarray(X), 9.0), np.where(A > 0, X, 9.0))
    check(cf.clip(cf.asarray(X), 1.5, 3.0), np.clip(X, 1.5, 3.0))
    with pytest.raises(ValueError):
        cf.asarray(A) + cf.asarray(np.ones(2))


@pytest.mark.parametrize("axis", [None, 0, 1, -1, (0, 1)])
@pytest.mark.parametrize("fill", [0, 2])
def test_reductions(axis, fill):
    a, x = cf.from_numpy(A, fill), cf.from_numpy(X, float(fill))
    for name in ("sum", "prod", "min", "max", "any", "all", "count_nonzero"):
        check(getattr(cf, name)(a, axis=axis), getattr(np, name)(A, axis=axis))
    for name in ("mean", "var", "std"):
        check(getattr(cf, name)(x, axis=axis), getattr(np, name)(X, axis=axis))
    check(cf.sum(a, axis=axis, keepdims=True), A.sum(axis=axis, keepdims=True))


@pytest.mark.parametrize("axis", [None, 0, 1])
def test_arg_extremes_and_nan(axis):
    for a in (X, A.astype(float), np.array([[1, np.nan], [3, 4]])):
        for fill in (0.0, 1.0, 9.0):
            t = cf.from_numpy(a, fill)
            check(cf.argmin(t, axis=axis), np.argmin(a, axis=axis))
            check(cf.argmax(t, axis=axis), np.argmax(a, axis=axis))
    n = np.array([[1, np.nan], [3, 4]])
    check(cf.min(cf.asarray(n), axis=axis), np.min(n, axis=axis))


def test_scans_sorts_and_search():
    s = np.array([[3.0, -1, 0, 3, 2], [0, 0, 5, -2, 1], [1, 1, 1, 0, 0]])
    for axis in (0, 1):
        t = cf.asarray(s)
        check(cf.cumulative_sum(t, axis=axis), np.cumsum(s, axis=axis))
        check(cf.cumulative_prod(t, axis=axis), np.cumprod(s, axis=axis))
        check(cf.sort(t, axis=axis), np.sort(s, axis=axis))
        check(cf.argsort(t, axis=axis), np.argsort(s, axis=axis, kind="stable"))
        check(cf.argsort(t, axis=axis, descending=True), np.argsort(-s, axis=axis, kind="stable"))
        check(cf.diff(t, axis=axis), np.diff(s, axis=axis))
    check(cf.cumulative_sum(cf.asarray(s[0]), include_initial=True), np.r_[0, np.cumsum(s[0])])
    check(cf.cumulative("maximum", cf.asarray(s), axis=1), np.maximum.accumulate(s, axis=1))
    edges = np.array([1.0, 2, 2, 4, 7])
    for side in ("left", "right"):
        check(cf.searchsorted(cf.asarray(edges), cf.asarray(s), side=side), np.searchsorted(edges, s, side=side))


def test_long_searchsorted(monkeypatch):
    from coordframe.operators import reductions

    monkeypatch.setattr(reductions, "MAX_SEARCHED", 0)
    edges, s = np.array([1.0, 2, 2, 4, 7]), np.array([[0.0, 2, 3], [7, 9, 1]])
    for side in ("left", "right"):
        check(cf.searchsorted(cf.asarray(edges), cf.asarray(s), side=side), np.searchsorted(edges, s, side=side))


def test_long_searchsorted_of_large_integers(monkeypatch):
    from coordframe.operators import reductions

    monkeypatch.setattr(reductions, "MAX_SEARCHED", 0)
    for dtype, base in (("int64", 2**53), ("int64", -(2**62)), ("uint64", 2**63)):
        edges, s = np.array([base, base + 1, base + 1, base + 3], dtype=dtype), np.array([base + 1, base + 2, base, base + 4], dtype=dtype)
        for side in ("left", "right"):
            check(cf.searchsorted(cf.asarray(edges), cf.asarray(s), side=side), np.searchsorted(edges, s, side=side))


Z = np.array([0.5 + 2j, -1.5 - 0.25j, 3 + 0j, -2 + 1e-3j, 1j, -0.75j, 0.3 - 4j, 25 + 1j, -30 - 2j])


def test_complex_functions():
    t = cf.asarray(Z)
    with np.errstate(all="ignore"):
        for name in "sqrt exp expm1 log log1p log2 log10 sin cos tan sinh cosh tanh sign square reciprocal negative".split():
            np.testing.assert_allclose(getattr(cf, name)(t).to_numpy(), getattr(np, name)(Z), rtol=1e-10, atol=1e-12, err_msg=name)
        for name, host in (("asin", np.arcsin), ("acos", np.arccos), ("atan", np.arctan), ("asinh", np.arcsinh), ("acosh", np.arccosh), ("atanh", np.arctanh)):
            z = np.array([x for x in Z if x not in (3 + 0j, 1j)])  # on the cuts and poles
            np.testing.assert_allclose(getattr(cf, name)(cf.asarray(z)).to_numpy(), host(z), rtol=1e-9, atol=1e-12, err_msg=name)
        zero = np.array([0j, 1 + 0j])
        for name in "sqrt exp sin tanh sign".split():
            np.testing.assert_allclose(getattr(cf, name)(cf.asarray(zero)).to_numpy(), getattr(np, name)(zero), atol=1e-15)
        powers = np.array([2, 0.5j, 0, -1, 2 - 1j, 3, 1, 0.5, 0.1])
        np.testing.assert_allclose((t ** cf.asarray(powers.astype(complex))).to_numpy(), Z**powers, rtol=1e-9)
        np.testing.assert_allclose((cf.from_numpy(zero, 1) ** 0.0).to_numpy(), zero**0.0)


def test_products_of_any_size(monkeypatch):
    from coordframe import relation

    for parts in (2, 4096):
        monkeypatch.setattr(relation, "PRODUCT_PARTS", parts)
        check(cf.prod(cf.asarray(Z)), np.prod(Z), 1e-9)
        check(cf.prod(cf.from_numpy(Z.reshape(3, 3), 1 + 1j), axis=0), np.prod(Z.reshape(3, 3), axis=0), 1e-9)
        check(cf.prod(cf.asarray(np.array([[3, -1, 2], [0, 5, 1]])), axis=1), [-6, 0])


def test_integer_powers(spark):
    base, n = np.array([3, -3, 7, 2, -2, 0, 1, -1, 10]), np.array([39, 39, 22, 62, 63, 0, 200, 201, 18])
    check(cf.asarray(base) ** cf.asarray(n), base**n)
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        check(cf.asarray(base) ** cf.asarray(n + 64), base ** (n + 64))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)


def test_divmod():
    a, b = np.array([7, -7, 9]), np.array([2, 2, -4])
    for got, want in zip(divmod(cf.asarray(a), cf.from_numpy(b, 3)), divmod(a, b), strict=True):
        check(got, want)
    for got, want in zip(divmod(20, cf.asarray(b)), divmod(20, b), strict=True):
        check(got, want)


@pytest.mark.parametrize("fill", [0.0, 2.0])
def test_variance_of_stored_cells(fill):
    for a, axis, correction in ((X, None, 0), (X, 0, 1), (X, (0, 1), 1), (np.array([[1.5, np.nan], [3, 4]]), 0, 0), (X.astype("float32"), 1, 0)):
        got = cf.var(cf.from_numpy(a, fill), axis=axis, correction=correction)
        assert got.dtype == a.dtype
        check(got, np.var(a, axis=axis, ddof=correction), 1e-6 if a.dtype == np.float32 else 1e-12)
    z = Z.reshape(3, 3)
    check(cf.var(cf.from_numpy(z, fill), axis=0), np.var(z, axis=0), 1e-10)
    check(cf.std(cf.asarray(X), axis=1, keepdims=True), np.std(X, axis=1, keepdims=True))
    n = 1 << 18
    wide = cf.from_coordinates(([5], [7]), [3.0], (n, n))
    assert cf.var(wide).item() == pytest.approx(9 / n**2 - (3 / n**2) ** 2, rel=1e-9)
    assert cf.std(wide, axis=0).to_df().count() == 1


def test_huge_arg_extremes():
    """Positions beyond 2**40 cells, of stored cells and of the first that isn't."""
    n = 1 << 21
    t = cf.from_coordinates(([0, 0, 5], [0, 1, 3]), [2, 7, -4], (n, n))
    assert cf.argmax(t).item() == 1 and cf.argmin(t).item() == 5 * n + 3
    up = cf.from_coordinates(([0, 0, 5], [0, 1, 3]), [2, 7, 4], (n, n))
    assert cf.argmin(up).item() == 2
    check(cf.argmax(cf.from_coordinates(([1], [0]), [-3], (3, 2)), axis=0), [0, 0])


@pytest.mark.parametrize("ranges", [2, 64])
def test_vectors_in_blocks(monkeypatch, ranges):
    from coordframe.operators import reductions

    monkeypatch.setattr(reductions, "SCAN_BLOCK", 4)
    monkeypatch.setattr(reductions, "SORT_RANGES", ranges)
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, 37)
    for x in (v, np.where(v == 2, np.nan, v.astype(float))) if ranges == 2 else (np.r_[v.astype(float), np.inf, -np.inf],):
        t = cf.asarray(x)
        check(cf.cumulative("add", t), np.cumsum(x))
        check(cf.cumulative("maximum", t), np.maximum.accumulate(x))
        check(cf.cumulative("minimum", t), np.minimum.accumulate(x))
        check(cf.cumulative_prod(t), np.cumprod(x))
        check(cf.sort(t), np.sort(x))
        check(cf.argsort(t), np.argsort(x, kind="stable"))
        check(cf.argsort(t, descending=True), np.argsort(np.where(np.isnan(x), np.inf, -x) if x.dtype.kind == "f" else -x, kind="stable"))
    check(cf.cumulative("logical_or", cf.asarray(v > 2)), np.logical_or.accumulate(v > 2))
    check(cf.sort(cf.asarray(v > 0)), np.sort(v > 0))
    many = np.full(50, 4.0)  # ties
    check(cf.argsort(cf.asarray(many)), np.arange(50))


def test_sparse_arrays_keep_their_cells():
    class Coo:
        row, col, data, shape = np.array([3, 0, 3]), np.array([1, 2, 1]), np.array([5, 7, -1]), (1 << 40, 1 << 40)

    t = cf.asarray(Coo())
    assert t.shape == Coo.shape and sorted(map(tuple, t.to_df().collect())) == [(0, 2, 7), (3, 1, 4)]

    class Coords:
        coords, data, shape, fill_value = np.array([[0, 1], [2, 0], [1, 1]]), np.array([1.5, 2.0]), (2, 3, 2), 2.0

    want = np.full((2, 3, 2), 2.0)
    want[0, 2, 1] = 1.5
    check(cf.asarray(Coords()), want)
    with pytest.raises(ValueError):
        cf.from_coordinates(([3],), [1], (3,))


def test_expansion_is_bounded():
    with pytest.raises(ValueError):
        cf.zeros((1 << 20, 1 << 20)).rel.dense()
    with pytest.raises(ValueError):
        cf.from_coordinates(([0], [0]), [1], (4, 1 << 40)).rel.dense(["i1"])


def test_shapes():
    a, t = A, cf.asarray(A)
    check(t.T, a.T)
    check(cf.reshape(t, (3, -1)), a.reshape(3, -1))
    check(cf.expand_dims(t, 1), a[:, None])
    check(cf.squeeze(cf.expand_dims(t, 0), 0), a)
    check(cf.flip(t), np.flip(a))
    check(cf.roll(t, 1, axis=1), np.roll(a, 1, axis=1))
    check(cf.roll(t, 2), np.roll(a, 2))
    check(cf.concat([t, cf.from_numpy(B, 5)], axis=1), np.concatenate([a, B], axis=1))
    check(cf.stack([t, cf.asarray(B)], axis=1), np.stack([a, B], axis=1))
    check(cf.tile(t, (2, 2)), np.tile(a, (2, 2)))
    check(cf.repeat(t, 2, axis=0), np.repeat(a, 2, axis=0))
    check(cf.take(t, cf.asarray(np.array([2, 0, -1])), axis=1), np.take(a, [2, 0, -1], axis=1))
    ind = np.array([[0, 2], [1, 1]])
    check(cf.take_along_axis(t, cf.asarray(ind), axis=1), np.take_along_axis(a, ind, axis=1))
    check(cf.triu(cf.from_numpy(A, 3)), np.triu(a))
    check(cf.tril(t, k=-1), np.tril(a, -1))
    check(cf.diag(cf.asarray(np.array([1, 0, 2])), k=1), np.diag([1, 0, 2], 1))
    check(cf.diagonal(t, offset=1), np.diagonal(a, 1))
    check(cf.broadcast_to(t, (2, 2, 3)), np.broadcast_to(a, (2, 2, 3)))
    check(cf.moveaxis(cf.asarray(np.arange(24).reshape(2, 3, 4)), 0, -1), np.moveaxis(np.arange(24).reshape(2, 3, 4), 0, -1))
    check(t[0, ::-1], a[0, ::-1])
    check(t[..., 1:], a[..., 1:])
    check(t[:, None, [0, 2]], a[:, None, [0, 2]])
    assert [u.to_numpy().tolist() for u in cf.unstack(t)] == a.tolist()
    t[1, 1] = 9
    assert t.to_numpy()[1, 1] == 9


def test_creation():
    check(cf.eye(3, 4, k=1), np.eye(3, 4, k=1))
    check(cf.arange(2, 11, 3), np.arange(2, 11, 3))
    check(cf.linspace(0, 1, 5), np.linspace(0, 1, 5))
    check(cf.full((2, 3), 4), np.full((2, 3), 4))
    for got, want in zip(cf.meshgrid(cf.asarray(np.arange(3)), cf.asarray(np.arange(2))), np.meshgrid(np.arange(3), np.arange(2)), strict=True):
        check(got, want)
    assert cf.zeros((0, 3)).to_numpy().shape == (0, 3)
    check(cf.sum(cf.ones((4, 5))), 20.0)


def test_linear_algebra():
    rng = np.random.default_rng(42)
    a, b = rng.integers(-3, 4, (3, 4)), rng.integers(-3, 4, (4, 2))
    check(cf.asarray(a) @ cf.asarray(b), a @ b)
    check(cf.matmul(cf.asarray(a[0]), cf.asarray(b)), a[0] @ b)
    check(cf.matmul(cf.from_numpy(a, 1), cf.asarray(b[:, 0])), a @ b[:, 0])
    p, q = rng.normal(size=(2, 3, 4)), rng.normal(size=(2, 4, 5))
    check(cf.matmul(cf.asarray(p), cf.asarray(q)), p @ q, 1e-9)
    check(cf.tensordot(cf.asarray(p), cf.asarray(q), axes=([0, 2], [0, 1])), np.tensordot(p, q, axes=([0, 2], [0, 1])), 1e-9)
    check(cf.vecdot(cf.asarray(p), cf.asarray(p)), (p * p).sum(-1), 1e-9)
    check(cf.outer(cf.asarray(a[0]), cf.asarray(b[:, 0])), np.outer(a[0], b[:, 0]))
    check(cf.linalg.cross(cf.asarray(p[0, :, 0]), cf.asarray(p[1, :, 0])), np.cross(p[0, :, 0], p[1, :, 0]), 1e-9)
    s = rng.normal(size=(2, 3, 3)) + 3 * np.eye(3)
    check(cf.linalg.inv(cf.asarray(s)), np.linalg.inv(s), 1e-9)
    check(cf.linalg.det(cf.asarray(s)), np.linalg.det(s), 1e-9)
    check(cf.linalg.solve(cf.asarray(s[0]), cf.asarray(p[0, :, 0])), np.linalg.solve(s[0], p[0, :, 0]), 1e-9)
    check(cf.linalg.matrix_power(cf.asarray(A[:, :2]), 3), np.linalg.matrix_power(A[:, :2], 3))
    pp, low, up = cf.linalg.lu(cf.asarray(s[0]))
    check(pp @ low @ up, s[0], 1e-9)
    qq, rr = cf.linalg.qr(cf.asarray(p[0]))
    check(qq @ rr, p[0], 1e-9)
    check(cf.linalg.svdvals(cf.asarray(p[0])), np.linalg.svd(p[0], compute_uv=False), 1e-9)
    for ord in (0, 1, 2, 3, -1, np.inf, -np.inf):
        check(cf.linalg.vector_norm(cf.asarray(p[0] + 2), ord=ord), np.linalg.norm((p[0] + 2).ravel(), ord), 1e-9)
    for ord in ("fro", 1, -1, np.inf, 2, "nuc"):
        check(cf.linalg.matrix_norm(cf.asarray(p[0]), ord=ord), np.linalg.norm(p[0], ord), 1e-9)
    assert cf.linalg.vector_norm(cf.asarray(np.array([1e200, 1e200]))).item() == pytest.approx(2**0.5 * 1e200)
    check(cf.linalg.matrix_rank(cf.asarray(np.ones((3, 3)))), 1)


def test_fourier():
    x = np.array([[1.0, 0, 2, -1], [0, 3, 1, 1]])
    t = cf.asarray(x)
    check(cf.fft.fft(t), np.fft.fft(x))
    check(cf.fft.ifft(cf.fft.fft(t, axis=0), axis=0), x)
    check(cf.fft.rfft(t), np.fft.rfft(x))
    check(cf.fft.irfft(cf.fft.rfft(t)), x)
    check(cf.fft.fftn(t), np.fft.fftn(x))
    check(cf.fft.fftshift(t), np.fft.fftshift(x))
    check(cf.real(cf.fft.fft(t)) + cf.imag(cf.fft.fft(t)), np.fft.fft(x).real + np.fft.fft(x).imag)


def test_einsum_and_einop():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(-3, 4, (3, 4)), rng.integers(-3, 4, (4, 5)), rng.integers(-3, 4, (5, 2))
    for text, args in (("ij,jk->ik", (a, b)), ("ij,jk,kl->il", (a, b, c)), ("ij->ji", (a,)), ("ij,ij->", (a, a)), ("ii->i", (a[:, :3],)), ("ij,jk", (a, b)), ("...j,jk->...k", (a, b)), ("i,j->ij", (a[0], b[0]))):
        check(cf.einsum(text, *map(cf.asarray, args)), np.einsum(text, *args))
    check(cf.einsum(cf.asarray(a), [0, 1], cf.asarray(b), [1, 2], [0, 2]), a @ b)
    for s in ("naive", "greedy", "exact"):
        with cf.with_default_scheduler(s):
            check(cf.einop("C[i,l] += A[i,j] * B[j,k] * D[k,l]", A=a, B=b, D=c), a @ b @ c)
    check(cf.einop("C[i,j] = A[i,j] + 2 * A[i,j] ** 2", A=a), a + 2 * a**2)
    check(cf.einop("C[i,k] min= A[i,j] + B[j,k]", A=a, B=b), (a[:, :, None] + b[None]).min(axis=1))
    check(cf.einop("C[i,k] max= min(A[i,j], B[j,k])", A=a, B=b), np.minimum(a[:, :, None], b[None]).max(axis=1))
    check(cf.einop("C[i] or= A[i,j] > 1 and A[i,j] < 3", A=a), ((a > 1) & (a < 3)).any(axis=1))
    check(cf.einop("C[i] = A[i,j]", A=a), a[:, -1])
    check(cf.einop("C[j,i] = 1 < A[i,j] <= 3", A=a), ((1 < a) & (a <= 3)).T)
    check(cf.einop("s += sqrt(A[i,j] * A[i,j])", A=a), np.abs(a).sum())


def test_planner_costs():
    from coordframe.plans.planner import Size, order

    def sizes(dims, *terms):
        return [Size(frozenset(t), float(np.prod([dims[f] for f in t]))) for t in terms]

    dims = {"a": 1000, "b": 2, "c": 1000, "d": 2}
    got, cost = order(sizes(dims, "ab", "bc", "cd"), "ad", dims, "exact")
    assert got[0] == "c"  # the wide index goes first
    rng = np.random.default_rng(0)
    for _ in range(20):
        dims = {f: int(rng.integers(1, 200)) for f in "abcdef"}
        s = sizes(dims, "ab", "bc", "cd", "de", "ef")
        assert order(s, "af", dims, "exact")[1] <= order(s, "af", dims, "greedy")[1] * (1 + 1e-9)


@pytest.mark.parametrize("shrink", [0.0, 0.5, 1e9])
def test_sums_taken_late_or_early(monkeypatch, shrink):
    from coordframe.plans import planner

    monkeypatch.setattr(planner, "SHRINK", shrink)
    rng = np.random.default_rng(5)
    a, b, c, d = rng.integers(-2, 3, (4, 5)), rng.integers(-2, 3, (5, 6)), rng.integers(-2, 3, (6, 3)), rng.integers(-2, 3, (5, 6))
    check(cf.einsum("ij,jk,kl,jk->il", *map(cf.asarray, (a, b, c, d))), np.einsum("ij,jk,kl,jk->il", a, b, c, d))
    check(cf.einsum("ij,jk,kl->", *map(cf.asarray, (a, b, c))), (a @ b @ c).sum())
    keys = np.eye(5, dtype=int)[[0, 2, 2, 4]]  # each row has one cell
    check(cf.einop("C[i,l] += K[i,j] * B[j,k] * D[k,l]", K=keys, B=b, D=c), keys @ b @ c)
    check(cf.einop("C[i] or= K[i,j] > 0 and B[j,k] > 0", K=keys, B=b), ((keys @ (b > 0)) > 0).any(axis=1))


def test_ir():
    from coordframe.plans.ir import Aggregate, Alias, MapJoin, Plan, Produces, Query, Relabel, Reorder, Table

    add, mul = cf.ffuncs.get("add"), cf.ffuncs.get("multiply")
    a, b = np.array([[1, 2], [3, 4]]), np.array([[5, 6], [7, 8]])
    product = Aggregate(add, 0, MapJoin(mul, (Table(a, ("i", "j")), Table(b, ("j", "k")))), ("j",))
    plan = Plan((Query("C", Reorder(product, ("i", "k"))), Query("D", Reorder(Relabel(Alias("C"), ("k", "i")), ("i", "k"))), Produces(("C", "D")), Query("E", Alias("missing"))))
    c, d = plan.run()
    check(c, a @ b)
    check(d, (a @ b).T)
    nested = Aggregate(add, 0, Aggregate(add, 0, Table(a, ("i", "j")), ("j",)), ("i",))
    from coordframe.plans.ir import merged

    assert merged(nested).drop == ("j", "i")
    assert merged(nested).infer()["shape"] == ()


def test_custom_operators():
    def f(a, b):
        return a * a + b

    check(cf.elementwise(f, cf.asarray(X), cf.asarray(X)), X * X + X)
    sub = cf.ffuncs.custom("minus", np.subtract)
    check(cf.reduce(sub, cf.asarray(X), axis=1), X[:, 0] - X[:, 1] - X[:, 2])
    check(np.add(cf.asarray(X), 1.0), X + 1)


def test_stats_and_namespace():
    t = cf.asarray(A)
    assert cf.stats.exact(t) == 4
    assert cf.UniformStats.of(t).nnz == 4
    assert cf.DCStats.of(t).degree == {"i0": 2, "i1": 2}
    assert cf.stats.VPStats.of(t).distinct == {"i0": 2, "i1": 3}
    assert cf.BlockedStats.of(t, 2).nnz == 4
    assert t.__array_namespace__() is cf
    assert cf.isdtype(cf.int8, "signed integer") and not cf.isdtype(cf.int8, "real floating")


def test_statistics_follow_a_plan():
    from coordframe.plans.ir import Aggregate, Alias, MapJoin, Plan, Produces, Query, Relabel, Table
    from coordframe.plans.stats import q_error

    rng = np.random.default_rng(2)
    add, mul = cf.ffuncs.get("add"), cf.ffuncs.get("multiply")
    a, b = (np.where(rng.random((12, 9)) < p, 1, 0) for p in (0.3, 0.5))
    b = b.T
    join = MapJoin(mul, (Table(a, ("i", "j")), Table(b, ("j", "k"))))
    product = Aggregate(add, 0, join, ("j",))
    true_join, true_product = int((a[:, :, None] * b[None]).sum()), np.count_nonzero(a @ b)
    assert q_error(cf.estimate(join).nnz, true_join) < 1.5 and q_error(cf.estimate(product).nnz, true_product) < 1.5
    assert true_join <= cf.estimate(join, "lp").nnz <= np.count_nonzero(a) * np.count_nonzero(b)
    assert cf.estimate(product, "lp").nnz >= true_product
    both = MapJoin(add, (Table(a, ("i", "j")), Table(b.T, ("i", "j"))))
    true_both = np.count_nonzero(a + b.T)
    assert q_error(cf.estimate(both).nnz, true_both) < 1.5 and cf.estimate(both, "lp").nnz >= true_both
    plan = Plan((Query("C", product), Query("D", Relabel(Table(Alias("C"), ("x", "y")), ("p", "q"))), Produces(("C", "D"))))
    got = cf.estimate(plan)
    assert got["C"].nnz == got["D"].nnz and set(got["D"].dims) == {"p", "q"}
    skewed = np.zeros((6, 4), dtype=int)
    skewed[:, 1] = 1
    heavy = MapJoin(mul, (Table(skewed, ("i", "j")), Table(skewed.T, ("j", "k"))))
    assert cf.estimate(heavy, "lp").nnz == 36  # the heavy column, exactly
    assert cf.estimate(heavy, "dummy").dims == {"i": 6, "j": 4, "k": 6}
    assert cf.FDStats.of(cf.asarray(skewed)).dense == {"i0"} and cf.estimate(heavy, "fd").dense == {"i", "k"}
    assert q_error(2, 8) == q_error(8, 2) == 4


def test_capture_of_plans():
    a = np.arange(6).reshape(2, 3)
    with cf.LogicCapture() as seen:
        cf.einsum("ij,kj,kl->il", cf.asarray(a), cf.asarray(a), cf.asarray(a))
    cf.einsum("ij,kj->ik", cf.asarray(a), cf.asarray(a))
    assert len(seen.steps) == 1 and sorted(seen.steps[0]["order"]) == ["j", "k"] and seen.steps[0]["cost"] > 0


def test_programs_of_several_statements():
    a, b = np.arange(6).reshape(2, 3), np.arange(12).reshape(3, 4)
    made = cf.einop_program("""
        C[i,k] += A[i,j] * B[j,k]   # a product
        s += C[i,k]; D[i] max= C[i,k]
        D[i] = D[i] + s
    """, A=a, B=b)
    check(made["C"], a @ b)
    check(made["D"], (a @ b).max(axis=1) + (a @ b).sum())
    with pytest.raises(ValueError):
        cf.einop_program("C[i] A[i]", A=a)


def test_cells_by_a_key():
    x, key = np.array([[5, 6, 7], [8, 9, 1]]), np.array([[2.0, 1, 1], [0, 3, 3]])
    for axis in (0, 1):
        for got, pick in ((cf.min_by, np.argmin), (cf.max_by, np.argmax)):
            at = np.expand_dims(pick(key, axis=axis), axis)
            check(got(cf.asarray(x), cf.asarray(key), axis=axis), np.take_along_axis(x, at, axis=axis).squeeze(axis))
    assert cf.max_by(cf.asarray(x), cf.asarray(key)).item() == 9
    assert cf.min_by(cf.asarray(x), cf.asarray(key), axis=1, keepdims=True).shape == (2, 1)


def test_storage_round_trip(tmp_path, spark):
    for a, fill in ((A, 3), (X, 0.0), (X > 1.5, False), (X + 1j, 0)):
        t = cf.from_numpy(a, fill)
        path = str(tmp_path / f"{a.dtype}")
        cf.write_tensor(t, path)
        back = cf.read_tensor(spark, path)
        check(back, a)
        assert back.fill_value == t.fill_value


def test_large_shapes_that_need_no_expansion(spark):
    """A join over fields that both sides have makes no cells, whatever the shape."""
    x = cf.from_coordinates([[0, 1 << 40], [5, 7]], [3.0, 4.0], (1 << 41, 1 << 20), fill=5.0)
    assert cf.count_nonfill(x).item() == 2
    assert (x + x).df.count() == 2


def test_integer_products_wrap(spark):
    """Products of groups are modulo 2**64 in Spark's ANSI mode too."""
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**62), 2**62, (3, 50)) | 1
    a[1] = 2
    a[2, ::7] = 3
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    with np.errstate(all="ignore"):
        for fill in (1, 3):
            check(cf.prod(cf.from_numpy(a, fill), axis=1), np.prod(a, axis=1))
        check(cf.prod(cf.asarray(a)), np.prod(a))
        small = np.full((2, 9), 7, np.int32)
        check(cf.reduce("multiply", cf.asarray(small), axis=1), np.multiply.reduce(small, axis=1, dtype=np.int32))


def test_more_cells_than_int64_counts(spark):
    """Folds over more than 2**63 cells count them exactly."""
    n = 1 << 80

    def x(values, fill):
        return cf.from_coordinates([[0, 1 << 39], [5, 7]], values, (1 << 40, 1 << 40), fill=fill)

    assert cf.sum(x([3, 4], 0)).item() == 7
    assert cf.sum(x([3.0, 4.0], 0.5)).item() == (n - 2) * 0.5 + 7
    assert cf.prod(x([3, 4], 3)).item() == (pow(3, n - 1, 1 << 64) * 4 + (1 << 63)) % (1 << 64) - (1 << 63)
    assert cf.prod(x([3, 5], 2)).item() == 0
    eye = cf.from_coordinates([[1, 2], [1, 2]], [2, 3], (1 << 40, 1 << 40))
    assert cf.sum(cf.einop("R[i] += A[i,j] * B[j,k] * C[k,l]", A=eye, B=eye, C=eye)).item() == 35


@pytest.mark.parametrize("dense", [1e-9, 1e9])
def test_products_in_blocks(dense, monkeypatch):
    """Tiles and packed lists give what a join gives."""
    from coordframe.plans import blocks

    for name, value in (("LEAST", 1), ("GROWS", 0), ("ROWS", 4), ("LIST", 3), ("DENSE", dense)):
        monkeypatch.setattr(blocks, name, value)
    called, kept = [], {f: getattr(blocks, f) for f in ("tiled", "packed")}
    for f in kept:
        monkeypatch.setattr(blocks, f, lambda *a, f=f: called.append(f) or kept[f](*a))
    rng = np.random.default_rng(3)
    x, y = (rng.integers(-3, 4, s) * rng.integers(0, 2, s) for s in ((2, 9, 5), (2, 5, 7)))
    check(cf.einsum("bij,bjk->bik", cf.asarray(x), cf.asarray(y)), np.einsum("bij,bjk->bik", x, y))
    check(cf.matmul(cf.asarray(x[0]), cf.asarray(y[0])), x[0] @ y[0])
    check(cf.einsum("bij,bjk->ik", cf.asarray(x), cf.asarray(y)), np.einsum("bij,bjk->ik", x, y))
    assert called == ["tiled" if dense < 1 else "packed"] * 3
