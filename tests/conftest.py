from __future__ import annotations

import pytest

from ledgerlens.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("checkpoints"))
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=root,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LOAN_DDL = (
    "loan_id string, borrower_id string, borrower_name string, phone_number string, national_id string, amount double,"
    " loan_date date, created_at timestamp_ntz, approval_time string, officer_id string, officer_name string,"
    " branch_id string, branch_name string, status string, product_id string, guarantor_name string,"
    " latitude double, longitude double"
)


@pytest.fixture(scope="session")
def make_loans(spark):
    """Loan rows from dicts; whatever a row leaves out is null."""
    names = [part.split()[0] for part in LOAN_DDL.split(", ")]

    def make(rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOAN_DDL)

    return make
