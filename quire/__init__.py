"""quire: document-structure analytics and corpus operators as Spark plans."""
