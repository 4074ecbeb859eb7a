"""All queries of the offer engine, and their SQL."""

from offersieve.plans import arrivals, control, exchange, generations, messages, offers, outbox, presentation, services, users

PARTS = (offers, services, messages, control, presentation, exchange, users, arrivals, generations, outbox)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
