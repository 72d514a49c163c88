"""Analysis parameters and the fixed values the survey coding imposes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Age window and follow-up length shared by all analyses."""

    age_low: int = 20
    age_high: int = 64
    follow_up: int = 5
    bmi_low: float = 13.0
    bmi_high: float = 70.0
    obese_from: float = 30.0
    bootstrap_reps: int = 200
    imputations: int = 10
    donors: int = 5
    ridge: float = 1e-6
    seed: int = 1

    @property
    def oldest_start(self) -> int:
        """A group must have been seen at this age or younger."""
        return self.age_high - self.follow_up + 1

    @property
    def youngest_end(self) -> int:
        """A group must have been seen at this age or older."""
        return self.age_low + self.follow_up - 1


# Column names the yearly files may carry.
WAVE_COLUMNS = [
    "year", "age", "age90", "age35g", "bmi", "bmiok", "samptype", "sex", "wt_int",
]
WAVE_COLUMN_PATTERN = r"(ethni|ethin|ethcind|origin|topqual)"

# File selection of the catalogue.
WHOLE_FOLDERS = ["1991-1992", "1993"]
FILE_PATTERN = r"[0-9](ai|gp3|gpa)|eul"

# Fixed values: (first wave, last wave, column, lowest code, highest code).
ETHNICITY_RULES = [
    (1991, 1997, "ethnic", 1, 1),
    (1998, 1998, "nethnic", 1, 1),
    (1999, 2003, "ethnici", 1, 1),
    (2004, 2004, "ethcind", 1, 1),
    (2005, 2007, "ethinda", 1, 1),
    (2008, 2010, "origin", 1, 3),
    (2011, 2013, "origin", 1, 4),
    (2014, 2019, "origin2", 1, 1),
]

# Fixed values: (first wave, last wave, lowest code, highest code) of the core sample.
SAMPLE_RULES = [
    (2000, 2000, 2, 2),
    (2002, 2002, 2, 2),
    (2005, 2005, 1, 1),
    (2006, 2006, 1, 2),
    (2007, 2010, 1, 1),
    (2015, 2015, 1, 1),
]

# Waves whose age is top-coded, banded, or without education.
TOP_CODED_WAVE = 2014
TOP_CODE = 90
BANDED_WAVES = (2015, 2019)
NO_EDUCATION_WAVES = (1995, 1996)
BAND_CODES = (1, 21)

# Education labels of codes 1 to 8.
EDUCATION_LABELS = [
    "NVQ 4/5", "HE Below Degree", "NVQ3", "NVQ2",
    "NVQ1", "Foreign/Other", "None", "Current Student",
]

# Body-mass category lines and parameter display names.
BMI_LINES = [(18.5, "Normal"), (25.0, "Overweight"), (30.0, "Obese")]
PARAMETER_NAMES = {"mu": "Median", "sigma": "CoV", "nu": "Skewness"}
