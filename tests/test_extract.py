"""Flight extraction on small literal mails."""

import pytest

from tripmine.operators.extract import flight, flights_only, generic_flight, tracked_flight, vietjet_flight

VIETJET = (
    "VietJet Air itinerary",
    "tickets@vietjetair.com",
    "Hello traveller,\nBooking number KX7Q2P\nFlight Number VJ 871\nDeparture: DAD Arrival: PQC\nDeparture: 3 May 2027\n",
)
ENGLISH = (
    "Trip receipt",
    "desk@example.org",
    "Flight BA 2490 is issued.\nDeparture: London (LHR) Arrival: Boston (BOS)\nReference: MNB8VC\n",
)
SPANISH = (
    "LATAM: su viaje",
    "ventas@latam.com",
    "Numero de vuelo: LA 602\nSalida: Quito (UIO) Llegada: Cusco (CUZ)\nLocalizador: PLM4RT\n",
)
PORTUGUESE = (
    "GOL: bilhete emitido",
    "atende@voegol.com.br",
    "Numero do voo: G3 1187\nDesde Natal (NAT) para Belem (BEL)\nCodigo de confirmacao: WXY7K2\n",
)


def test_four_languages(mails):
    rows = flights_only(flight(mails(VIETJET, ENGLISH, SPANISH, PORTUGUESE))).orderBy("seq").collect()
    found = [
        (r.airline, r.flight_number, r.departure_airport, r.arrival_airport, r.departure_datetime, r.confirmation_code)
        for r in rows
    ]
    assert found == [
        ("VietJet Air", "VJ871", "DAD", "PQC", "3 May 2027", "KX7Q2P"),
        ("Unknown Airline", "BA2490", "LHR", "BOS", "", "MNB8VC"),
        ("LATAM Airlines", "LA602", "UIO", "CUZ", "", "PLM4RT"),
        ("GOL", "G31187", "NAT", "BEL", "", "WXY7K2"),
    ]


@pytest.mark.parametrize(
    "body",
    [
        "Flight: AA 123\n",  # no airports
        "From: JFK To: LAX\n",  # no number
        "Flight: AA 123\nFrom: JFK To: JFK\n",  # one airport
        None,
    ],
)
def test_no_generic_flight(mails, body):
    assert flights_only(generic_flight(mails(("Note", "x@example.com", body)))).count() == 0


def test_vietjet_airports_come_from_one_pattern(mails):
    body = "Flight No. VJ 123\nFrom: SGN\nDAD -> HAN\n"
    row = flights_only(vietjet_flight(mails(("VietJet", "x", body)))).first()
    assert (row.departure_airport, row.arrival_airport) == ("DAD", "HAN")


def test_odd_letters_reach_the_pattern(mails):
    # A dotless i and a long s match i and s when case is ignored.
    body = "flıght AA 123\nfrom JFK to LAX\n"
    assert flights_only(generic_flight(mails(("Note", "x", body)))).first().flight_number == "AA123"


def test_keep_leaves_the_body_behind(mails):
    assert flight(mails(ENGLISH), keep=["seq"]).columns == ["seq", "flight"]


def test_tracker_scores(spark):
    texts = [
        ("booking ABC123 on flight VN 12, departure soon", ("ABC123", "BC123", 1.0, 2)),
        ("USD 500 paid", (None, "SD500", 0.4, 0)),
        ("AB 12345", (None, None, 0.0, 0)),
        ("pnr: ABCDEFG", (None, None, 0.0, 0)),
        ("Flight boarding arrival", (None, None, 0.2, 3)),
        ("", (None, None, 0.0, 0)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "seq int, text string")
    rows = tracked_flight(df).orderBy("seq").collect()
    got = [(r.confirmation_code, r.flight_number, r.confidence, r.flight_context_count) for r in rows]
    assert got == [expected for _, expected in texts]
