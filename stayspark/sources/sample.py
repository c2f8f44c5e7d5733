"""Ten hand-written rows per table.  Fixed values; all of it is fictional."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from stayspark.model import TABLES

HOTELS = [
    (4001, "Crowne Plaza London Ealing", "02082333200", "Western Avenue, Ealing", "W5 1HG", 0),
    (4002, "Dorsett City London", "02038051000", "9 Aldgate High Street", "EC3N 1AH", 1),
    (4003, "The Montana", "01803380449", "21 Belgrave Rd", "Q2 5HU", 1),
    (4004, "Sea Containers London", "02037471000", "20 Upper Ground", "SE1 9PD", 0),
    (4005, "Grand Royale London Hyde Park", "02073137900", "1-9 Inverness Terrace", "W2 3JP", 1),
    (4006, "Park Grand London Hyde Park", "02072624521", "78-82 Westbourne Terrace", "W2 6QA", 1),
    (4007, "The 29 London", "02078340205", "29-31 St Georges Dr", "SW1V 4DG", 0),
    (4008, "Astor Court Hotel", "02076364133", "20 Hallam St", "W1W 6JQ", 1),
    (4009, "New Linden Hotel", "02072214321", "59 Leinster Square", "W2 4PS", 1),
    (4010, "Hampton by Hilton London Waterloo", "02074018080", "157 Waterloo Rd", "SE1 8XA", 0),
]

CUSTOMERS = [
    (1001, "Romali", "Bottle", "12 Maple Avenue", "M1 4SD", "9310129780", 69),
    (1002, "Roshali", "Tottle", "48 Oak Lane", "M2 9SD", "8310129780", 89),
    (1003, "Bomali", "Rottle", "5 Elm Close", "M3 5SD", "9310129770", 29),
    (1004, "Simon", "Williams", "17 High Street", "L3 1SD", "8989197919", 18),
    (1005, "Michel", "Cub", "2 Market Street", "L2 3SD", "9129397802", 26),
    (1006, "Christen", "Hindu", "9 Temple Road", "CH2 7Y2", "7210265809", 68),
    (1007, "Mathew", "Perry", "221 Baker Street", "BS2 1KY", "7302897501", 55),
    (1008, "Ricky", "Ponting", "10 Downing Street", "DS2 1KT", "7927896203", 77),
    (1009, "Frank", "Ribery", "3 Berlin Street", "BS2 2KY", "8077762832", 40),
    (1010, "Cheryl", "Holman", "7 Nashville Ave", "TN3 7Z0", "6155371731", 32),
]

# Arrival, checkout, cancelled, guests, meal, customer, hotel.
BOOKINGS = [
    (1000001, date(2019, 7, 1), date(2019, 7, 19), 0, None, 1, 1, 1001, 4001),
    (1000002, date(2020, 5, 2), date(2020, 5, 11), 0, None, 2, 0, 1002, 4002),
    (1000003, date(2021, 6, 3), date(2021, 6, 22), 0, None, 3, 1, 1003, 4003),
    (1000004, date(2022, 4, 4), date(2022, 4, 10), 0, None, 1, 1, 1004, 4004),
    (1000005, date(2022, 4, 4), date(2022, 4, 20), 1, None, 2, 1, 1005, 4005),
    (1000006, date(2022, 4, 4), date(2022, 4, 8), 0, None, 2, 0, 1006, 4006),
    (1000007, date(2022, 4, 4), date(2022, 4, 16), 0, None, 1, 1, 1007, 4007),
    (1000008, date(2022, 4, 4), date(2022, 4, 22), 0, None, 3, 1, 1008, 4008),
    (1000009, date(2022, 4, 4), date(2022, 4, 15), 0, None, 4, 1, 1009, 4009),
    (1000010, date(2022, 4, 4), date(2022, 4, 19), 1, None, 1, 1, 1010, 4010),
]

ROOMS = [
    (100, "Single", 100, 4001, 1000001),
    (711, "Double", 110, 4002, 1000002),
    (109, "Double", 113, 4003, 1000003),
    (508, "Triple", 225, 4004, 1000004),
    (103, "Studio", 215, 4005, 1000005),
    (204, "Studio", 250, 4006, 1000006),
    (305, "Single", 105, 4007, 1000007),
    (506, "Double", 112, 4008, 1000008),
    (707, "Triple", 212, 4009, 1000009),
    (808, "Studio", 260, 4010, 1000010),
]

INVOICES = [
    (2001, 1000001, None, 60, date(2019, 7, 19), "12:33"),
    (2002, 1000002, None, 33, date(2020, 5, 11), "02:00"),
    (2003, 1000003, None, 20, date(2021, 6, 22), "11:20"),
    (2004, 1000004, None, 29, date(2022, 4, 10), "12:10"),
    (2005, 1000005, None, 34, date(2022, 4, 20), "03:33"),
    (2006, 1000006, None, 23, date(2022, 4, 8), "10:10"),
    (2007, 1000007, None, 19, date(2022, 4, 16), "11:57"),
    (2008, 1000008, None, 13, date(2022, 4, 22), "01:13"),
    (2009, 1000009, None, 24, date(2022, 4, 15), "12:10"),
    (2010, 1000010, None, 19, date(2022, 4, 19), "01:17"),
]

FEEDBACK = [
    (101, 1000001, "Hotel room was very small, not recommended.", 2, 4001),
    (102, 1000002, "Very nice and clean room, staff were friendly as well.", 5, 4002),
    (103, 1000003, "Listing said the room sleeps 3 but the third bed was a sofa.", 1, 4003),
    (104, 1000004, "Pretty decent; the integrated kitchen was a nice touch.", 4, 4004),
    (105, 1000005, "Room had no ventilation at all.", 2, 4005),
    (106, 1000006, "Cheap and cheerful, great for students.", 5, 4006),
    (107, 1000007, "Room was alright but the staff were excellent.", 4, 4007),
    (108, 1000008, "Room could have been bigger but no major complaints.", 3, 4008),
    (109, 1000009, "Bathroom was small but a decent studio overall.", 4, 4009),
    (110, 1000010, "The single room was barely big enough to walk in.", 1, 4010),
]

# The three documents of the hotel catalogue.
CATALOGUE = [
    {"ID": "4002", "NAME": "Dorsett City London", "STAR": "4", "CITY": "London", "COUNTRY": "UK"},
    {
        "ID": "4005",
        "NAME": "Grand Royale London Hyde Park",
        "STAR": "4",
        "CITY": "London",
        "COUNTRY": "UK",
    },
    {
        "ID": "4010",
        "NAME": "Hampton by Hilton London Waterloo",
        "STAR": "3",
        "CITY": "London",
        "COUNTRY": "UK",
    },
]

ROWS = {
    "Hotel": HOTELS,
    "Customer": CUSTOMERS,
    "Booking": BOOKINGS,
    "Room": ROOMS,
    "Invoice": INVOICES,
    "Feedback": FEEDBACK,
}


def sample_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(ROWS[name], TABLES[name].schema)
