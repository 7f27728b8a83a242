"""Column functions: variant keys, sequence text, coordinates and the normal quantile."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def neg_log10(p: str | Column, eps: float = 0.0) -> Column:
    """-log10(p + eps); null where p + eps is not positive."""
    p = _col(p) + F.lit(float(eps))
    return F.when(p > 0, F.lit(0.0) - F.log10(p))


def variant_key(chrom="chromosome", pos="position", ref="ref", alt="alt") -> Column:
    return F.concat_ws("_", _col(chrom), _col(pos).cast("string"), _col(ref), _col(alt))


def with_chr(chrom: str | Column) -> Column:
    """Chromosome name with the prefix ``chr`` once."""
    return F.concat(F.lit("chr"), F.regexp_replace(_col(chrom), "^(?:chr)+", ""))


def bin_key(chrom="chrom", start="bin_start", end="bin_end") -> Column:
    return F.concat_ws("_", _col(chrom), _col(start).cast("string"), _col(end).cast("string"))


def bin_mid(start="bin_start", end="bin_end") -> Column:
    return F.floor((_col(start) + _col(end)) / 2).cast("long")


def context_label(celltype="celltype", assay="assay") -> Column:
    return F.concat_ws("---", _col(celltype), _col(assay))


def dna_tokens(seq: str | Column) -> Column:
    """A, C, G, T, N as 0 to 4, in either case; any other letter makes the whole result null."""
    seq = F.upper(_col(seq))
    digits = F.split(F.translate(seq, "ACGTN", "01234"), "")
    tokens = F.transform(F.filter(digits, lambda x: x != ""), lambda x: x.cast("int"))
    return F.when(seq.rlike("^[ACGTN]*$"), tokens)


def splice(seq: str | Column, at: str | Column, ref: str | Column, alt: str | Column) -> Column:
    """``seq`` with ``ref`` at 0-based offset ``at`` replaced by ``alt``."""
    seq, at, ref, alt = map(_col, (seq, at, ref, alt))
    at = at.cast("int")
    return F.concat(F.substring(seq, F.lit(1), at), alt, F.substring(seq, at + F.length(ref) + 1, F.length(seq)))


def bin_coord(pos, start, end, bins) -> Column:
    """Fractional bin of a position in [start, end), clipped to 0 .. bins."""
    pos, start, end, bins = map(_col, (pos, start, end, bins))
    x = (pos - start).cast("double") / (end - start).cast("double") * bins
    return F.greatest(F.lit(0.0), F.least(bins.cast("double"), x))


def tss(start="start_pos", end="end_pos", strand="strand") -> Column:
    """Transcription start site: the start on the forward strand, else the end."""
    return F.when(_col(strand) == "+", _col(start)).otherwise(_col(end))


def gtf_attribute(name: str, attribute="attribute") -> Column:
    found = F.regexp_extract(_col(attribute), f'{name} "([^"]+)"', 1)
    return F.when(found != "", found)


# Coefficients of Wichura's algorithm AS 241 (PPND16), lowest power first.
AS241 = {
    "a": (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    "b": (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    "c": (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    "d": (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    "e": (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    "f": (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
}


def normal_quantile_sql(p: str) -> str:
    """The quantile of the standard normal at SQL expression ``p``, in text that both engines run."""

    def poly(name: str, x: str) -> str:
        text = f"{AS241[name][-1]!r}e0" if "e" not in repr(AS241[name][-1]) else repr(AS241[name][-1])
        for c in reversed(AS241[name][:-1]):
            text = f"({text} * {x} + {c!r}" + ("e0)" if "e" not in repr(c) else ")")
        return text

    q = f"(({p}) - 5e-1)"
    tail = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1e0 - ({p}) END))"
    central = f"{q} * {poly('a', f'(1.80625e-1 - {q} * {q})')} / {poly('b', f'(1.80625e-1 - {q} * {q})')}"
    near = f"{poly('c', f'({tail} - 1.6e0)')} / {poly('d', f'({tail} - 1.6e0)')}"
    far = f"{poly('e', f'({tail} - 5e0)')} / {poly('f', f'({tail} - 5e0)')}"
    return (
        f"CASE WHEN abs({q}) <= 4.25e-1 THEN {central} "
        f"ELSE (CASE WHEN {q} < 0 THEN -1e0 ELSE 1e0 END) * (CASE WHEN {tail} <= 5e0 THEN {near} ELSE {far} END) END"
    )


def critical_value_sql(p_cut: float, n_tests: str) -> str:
    """Two-sided Bonferroni critical value for ``n_tests`` tests."""
    return normal_quantile_sql(f"1e0 - {p_cut!r}e0 / CAST({n_tests} AS DOUBLE) / 2e0")
