"""Column expressions and scalar functions of the text analyzer."""
