import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", 4)
    yield session
    session.stop()


ARTICLES = [
    (147, "Obligations", "Contracts", "العقد شريعة المتعاقدين فلا يجوز نقضه ولا تعديله الا باتفاق الطرفين",
     "The contract makes the law of the parties.", False, 34, [148]),
    (148, "Obligations", "Contracts", "(1) يجب تنفيذ العقد طبقا لما اشتمل عليه.\n(2) ولا يقتصر العقد علي الزام المتعاقد بما ورد فيه",
     "(1) The contract must be performed in good faith.\n(2) A contract binds the parties to its contents.", False, 34, [147]),
    (54, "General", "Persons", "الغيت المواد من 54 الي 80", "Articles 54-80 have been repealed.", True, 8, []),
]


@pytest.fixture(scope="session")
def articles(spark):
    rows = [(n, b, None, c, None, None, ar, ar, en, rep, page, f"Egyptian Civil Code, Article {n}", refs)
            for n, b, c, ar, en, rep, page, refs in ARTICLES]
    from lexmill.schemas import ARTICLE

    return spark.createDataFrame(rows, ARTICLE)
