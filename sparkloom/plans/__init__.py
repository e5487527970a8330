"""Registered queries: how operators are put together over the tables, each with the same query in SQL."""

from sparkloom.plans import calls, chat, dialogue, prompts, retrieval, service, settings, store

QUERIES = {**retrieval.QUERIES | store.QUERIES, **dialogue.QUERIES, **service.QUERIES, **chat.QUERIES | calls.QUERIES | prompts.QUERIES | settings.QUERIES}
ORACLE = {**retrieval.ORACLE | store.ORACLE, **dialogue.ORACLE, **service.ORACLE, **chat.ORACLE | calls.ORACLE | prompts.ORACLE | settings.ORACLE}
