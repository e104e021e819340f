"""Annual factors against published result rows of three companies."""

from tidemark.operators import annual

# Counts as they were read from the filings, by year.
READ = {
    "jpm": {2013: 2014, 2014: 35, 2015: 1, 2016: 2, 2017: 5, 2018: 3, 2019: 14, 2020: 12, 2021: 18, 2022: 2},
    "nvda": {2014: 1, 2015: 10, 2016: None, 2017: 10, 2018: 1, 2019: 57, 2020: None, 2021: 22, 2022: 14, 2023: 0},
    "tsla": {2014: 17, 2015: None, 2016: 26, 2017: 14, 2018: 48, 2019: 0, 2020: 3, 2022: 4, 2023: 2},
}
# The published counts after cleaning.
CLEANED = {
    "jpm": {2014: 3, 2015: 1, 2016: 2, 2017: 5, 2018: 3, 2019: 14, 2020: 12, 2021: 18, 2022: 2, 2023: 2},
    "nvda": {2014: 1, 2015: 10, 2016: 3, 2017: 10, 2018: 1, 2019: 3, 2020: 3, 2021: 22, 2022: 14, 2023: 11},
    "tsla": {2014: 17, 2015: 21, 2016: 26, 2017: 14, 2018: 15, 2019: 11, 2020: 3, 2022: 4, 2023: 2},
}
# Developments and mean salaries of one company by year, and the years of its published factor rows.
DEVELOPMENTS = {2014: 105, 2015: 103, 2016: 103, 2017: 128, 2018: 108, 2019: 92, 2020: 101, 2021: 62, 2022: 54, 2023: 73, 2024: 9}
SALARIES = {2014: 234.175, 2015: 209.42983333, 2016: 320.3006, 2017: 283.7345, 2018: 277.50425, 2019: 215.7992, 2020: 209.05025, 2021: 190.9615, 2022: 200.0}
FACTOR_YEARS = (2014, 2015, 2016, 2017, 2018, 2019, 2020, 2022)


def _reports(spark):
    parts = [
        spark.createDataFrame([(t, y, None if n is None else float(n)) for y, n in years.items()], "ticker string, year int, count double")
        for t, years in READ.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def test_cleaned_filing_counts(spark):
    got = annual.culture_counts(_reports(spark)).collect()
    cleaned = {(t, y): n for t, years in CLEANED.items() for y, n in years.items()}
    mine = {(r["ticker"], r["year"]): r["culture_emphasis"] for r in got}
    assert {k: v for k, v in mine.items() if k[0] in CLEANED} == cleaned


def test_factor_rows(spark):
    pay = spark.createDataFrame([("TSLA", y, s) for y, s in SALARIES.items()], "TICKER string, YEAR int, SALARY_SALARY_mean double")
    developments = spark.createDataFrame([("Tesla, Inc.", y, n) for y, n in DEVELOPMENTS.items()], "companyname string, year int, count long")
    got = annual.factor_table(pay, developments, annual.culture_counts(_reports(spark))).orderBy("YEAR").collect()
    assert [tuple(r[c] for c in ("TICKER", "YEAR", "SALARY_SALARY_mean", "ART_COUNT", "CULT_EMPH")) for r in got] == [
        ("TSLA", y, SALARIES[y], DEVELOPMENTS[y], CLEANED["tsla"][y]) for y in FACTOR_YEARS
    ]
