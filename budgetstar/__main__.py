"""``python -m budgetstar SOURCE_CSV TARGET_FOLDER [YEAR]``: build the layers and print the reports."""

import sys

from budgetstar.plans.pipeline import executive_reports, run_pipeline
from budgetstar.session import build_session
from budgetstar.sources.shared import drop_intermediate


def main(arguments: list[str]) -> None:
    source, target = arguments[:2]
    year = int(arguments[2]) if len(arguments) > 2 else 2024
    spark = build_session()
    result = run_pipeline(spark, source, target)
    result.volumes.show()
    for name, report in executive_reports(result.star, year).items():
        print(name)
        report.show(truncate=False)
    drop_intermediate(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
