"""Library configurations: ``key=value`` sections, one ``[LIB]`` each, after global keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Keys of the format: whole numbers with their defaults, and kinds of files.
NUMBERS = {"avg_ins": 0, "min_ins": 0, "max_ins": 0, "rd_len_cutoff": 0, "reverse_seq": 0, "asm_flags": 3, "rank": 0, "pair_num_cutoff": 0, "map_len": 0}
FILES = ("f1", "f2", "q1", "q2", "p", "f", "q", "b")
SCHEMA = "lib_id int, max_rd_len int, " + ", ".join(f"{c} int" for c in NUMBERS) + ", files array<struct<kind: string, path1: string, path2: string>>"


def parse(text: str) -> list[tuple]:
    """Rows of all libraries, by ascending mean insert size."""
    longest, libs = 100, []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line.upper() == "[LIB]":
            libs.append((dict(NUMBERS), {k: [] for k in FILES}))
        elif "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            key = {"rd_len_cutof": "rd_len_cutoff"}.get(key, key)
            if not libs:
                longest = int(value) if key == "max_rd_len" else longest
            elif key in NUMBERS:
                libs[-1][0][key] = int(value)
            elif key in FILES:
                libs[-1][1][key].append(value)
    rows = []
    for n, (numbers, files) in enumerate(sorted(libs, key=lambda x: x[0]["avg_ins"])):
        listed = [(k[0] + "12", a, b) for k in ("f1", "q1") for a, b in zip(files[k], files[k[0] + "2"])]
        listed += [(k, path, None) for k in ("p", "b", "f", "q") for path in files[k]]
        rows.append((n, longest, *numbers.values(), listed))
    return rows


def libraries(spark: SparkSession, path: str) -> DataFrame:
    """The libraries of one configuration file."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    return spark.createDataFrame(parse(text), SCHEMA)


def for_stage(libs: DataFrame, scaffold: bool) -> DataFrame:
    """Libraries whose stage mask holds: 1 or 3 for contigs, 2 or 3 for scaffolds."""
    return libs.where("asm_flags in (2, 3)" if scaffold else "asm_flags in (1, 3)")
