"""Training-data operators over text corpora, embeddings and conversations.

Each module holds one operator with its own interface; ``queries`` registers the
thin ``opN_*`` queries. Nothing outside this folder imports it."""
