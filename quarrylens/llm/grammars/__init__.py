"""The bundled grammars: of each language a grammar text, a lexer and the actions that check context."""
